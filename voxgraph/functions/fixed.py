"""Word lists and patterns that results depend on, each whole and in the order of its source."""

# ruff: noqa: E501
# fixed values
VERBS = """
    add added adds argue argued argues ask asked asks claim claimed claims comment commented comments
    continue continued continues declare declared declares explain explained explains note noted notes
    reply replied replies report reported reports respond responded responds say said says stated tell
    told tweet tweeted tweets warn warned warns write writes wrote
""".split()
NEW_SPEAKER = r"(?:[.!?]\s+|\b)(another|other|meanwhile|separately)\b.{0,120}\b(said|saying|says|added|argued|warned|replied|responded|made)\b"
NAMED_NEXT = r"[.!?]\s+(?!(?:The|This|That)\b)[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,3}.{0,80}\b(said|says|told|wrote|tweeted|added|argued|warned|replied|responded)\b"
FORWARD = r"\b(similarly|also)\s+.{0,80}\b(said|says|argued|warned|replied|responded)\s+(that|:)\s*$"
REPLY = r"\b(replied|responded)\s*:?\s*$"
BACKGROUND = r"""^["']?\s*(in|on|at|during|after|before|when|while)\b"""
SWITCH = r"\b(on the other hand|meanwhile|however|but|countered|disputed|criticized|rejected|responding to|in response)\b"
BOILERPLATE = r"\b(copyright|all rights reserved|advertisement|photo|caption|newsletter|sign up|read more)\b"
INSTITUTION = r"\b(?:the\s+(?:report|agency|company|department|administration|committee|filing|document|piece|editorial|statement|lawsuit|brief|memo|order|ruling|opinion|complaint|indictment|motion|petition|judgment|news\s+release|press\s+release|suit|tweet|email|release|notice|warning|letter|message|post|note|book)\s+(?:said|says|stated|states|reads|read|notes|noted|reports|reported|added|continues|continued|alleges|alleged|claims|claimed|argues|argued|finds|found|wrote|writes|warns|warned)|it\s+(?:said|states|reads|read|notes|reports|added|continues|continued)|(?:an?\s+)?editorial\s+(?:in|said|read|notes|states)|in\s+a\s+statement|a\s+statement\s+(?:said|read)|according\s+to\s+the\s+(?:report|agency|company|department|filing|document|statement|lawsuit|brief|news\s+release|press\s+release|editorial|memo|letter)|(?:said|read|reads|states|notes|wrote)\s+the\s+(?:report|agency|company|department|filing|document|statement|lawsuit|brief|news\s+release|press\s+release|editorial|memo|letter|tweet|post|order|ruling|opinion|piece|suit|book|message)|(?:said|read)\s+an?\s+(?:editorial|statement|filing|brief|memo|complaint|indictment|motion|order|ruling|petition|lawsuit|press\s+release|news\s+release|email|tweet|letter|message)|the\s+(?:source|spokesperson|spokeswoman|spokesman)\s+(?:said|added|stated)|said\s+the\s+source|the\s+(?:company|filing|suit|report|agency)\s+(?:stated|said|added|alleges|claims|reads|states|notes))\b"
PERSON = r"\b(?:said|says|told|wrote|writes|tweeted|tweet|added|adds|argued|argues|warned|warns|replied|responded|responds|continued|continues|noted|notes|explained|explains|declared|declares|commented|comments|stated|asked|asks)\s+(?:\w+\s+){0,10}?(?:[A-Z][A-Za-z.'-]+)(?:\s+[A-Z][A-Za-z.'-]+){0,3}\b|\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Rep|Sen|Gov|President|Senator|Representative|Governor|Sens|Reps|Sir|Dame|Lord|Lady|Judge|Justice|Chief|Officer|Detective|Captain|Lieutenant|General|Colonel|Major|Rabbi|Imam|Father|Sister|Brother)\.?\s+[A-Z][A-Za-z.'-]+\b|\b[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,3}\s+(?:,\s*[^,]{1,80},\s+)?(?:said|says|told|wrote|writes|tweeted|added|argued|warned|replied|responded|continued|noted|explained|declared|commented|stated)\b"
ABBREVIATIONS = """
    mr mrs ms dr prof rep reps sen sens jr sr st
""".split()
PRONOUNS = """
    he she they him her them his hers their theirs
""".split()
TITLES = """
    mr mrs ms miss dr prof rep reps sen sens senator representative governor gov president
""".split()

# fixed values: words of attribution scores
TITLE_TOKENS = "chief deputy dr governor gov mr mrs ms president prof rep representative secretary sen senator".split()
QUOTATIVE_VERBS = "added announced asked insisted replied responded said says stated told tweeted warned wrote".split()
UNKNOWN_MARKERS = ("", "unknown", "none", "no speaker", "not stated", "not found", "n/a", "null")
INSTITUTIONAL_PROXY = (
    r"\bthe\s+(?:report|agency|company|department|administration|committee|"
    r"filing|document|piece|editorial|statement|lawsuit|brief|memo|order|"
    r"ruling|opinion|complaint|indictment|motion|petition|judgment|"
    r"news\s+release|press\s+release|suit|note|tweet|email|letter|release|"
    r"notice|warning)\b|"
    r"\bit\s+(?:said|states|reads|notes|reports|added|continues)\b|"
    r"\b(?:an?\s+)?editorial\s+(?:in|said|read)\b|"
    r"\bin\s+a\s+statement\b|"
    r"\baccording\s+to\s+the\s+(?:report|agency|company|department|filing|"
    r"document|statement|lawsuit|brief|news\s+release|press\s+release|"
    r"editorial|memo)\b|"
    r"\b(?:said|read)\s+an?\s+(?:editorial|statement|filing|brief|memo|"
    r"complaint|indictment|motion|order|ruling|petition|lawsuit|press\s+release|"
    r"news\s+release)\b|"
    r"\bthe\s+(?:company|filing|suit|report|agency)\s+(?:stated|said|added|"
    r"alleges|claims|reads|states|notes)\b"
)
# fixed values: labels of a quotation without a speaker in the text
NO_SPEAKER = ("-1", "none", "not_quote", "not_mentioned", "not_en", "ambiguous", "other")
