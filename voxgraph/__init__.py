"""voxgraph: who-talks-about-whom analytics as DataFrame plans."""
