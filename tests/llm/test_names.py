from voxgraph.llm import names

SPELLINGS = {
    1: ["Elizabeth Barorangu", "Betty Barorangu", "Barorangu, Elizabeth", "Elizabeth D. Barorangu", "ED Barorangu", "Barorangu E", "Judge Barorangu", "Elizabath Barorrngu", "ELIZABETH BARORANGU", " elizabeth  barorangu", "Barorangu ’s", "Elizabeth-Barorangu"],
    2: ["Hana Lamikaga", "H. Lamikaga"], 3: ["Ivo Lamikaga", "I. Lamikaga", "Ivo Lamiakga"],
    4: ["Helaqaport Institute of Harbours", "Helaqaport Inst. of Harbours", "Institute of Harbours, Helaqaport", "The Helaqaport Institute of Harbours", "Helaqaport IoH (Harbours)", "Helaqaport Harbours Institute", "Helaqaport Institute of Harboars"],
    5: ["Helaqaport University of Harbours"], 6: ["Zoran Q"],
}
NOBODY = ["", " ", "None", "he", "They", "the minister", "a spokesman", "...", None]


def frame(spark):
    rows = [(n, 1) for group in SPELLINGS.values() for n in group] * 2 + [(n, 2) for n in NOBODY] + [("Lamikaga", 3)]
    return spark.createDataFrame(rows, "name string, cluster int")


def test_variants_meet_and_others_do_not(spark):
    got = {r.name: r.cluster for r in names.name_clusters(frame(spark), "name").collect()}
    for group in SPELLINGS.values():
        assert len({got[n] for n in group}) == 1, {n: got[n] for n in group}
    assert len({got[g[0]] for g in SPELLINGS.values()}) == len(SPELLINGS)
    assert not set(got) & {n for n in NOBODY if n} and got["Lamikaga"] not in {got["Hana Lamikaga"], got["Ivo Lamikaga"]}


def test_pairs_are_ordered_and_whole(spark):
    pairs = {(r.lo, r.hi) for r in names.name_pairs(frame(spark), "name").collect()}
    assert all(a < b for a, b in pairs) and sum("baror" in a.lower() for a, _ in pairs) == 66
    assert names.name_pairs(frame(spark).limit(0), "name").count() == 0


def test_one_edit():
    assert names.one_edit("lodisonne", "loidsonne") and names.one_edit("abc", "abcd") and names.one_edit("abc", "axc") and not names.one_edit("abcd", "dcba") and not names.one_edit("ab", "abcd")


def test_short_forms_with_a_typing_error(spark):
    rows = ["Elizabeth Barorangu", "Barorrangu", "Judge Baroragnu", "E. Barorangi", "X. Barorango", "Hana Lamikaga", "Ivo Lamikaga", "Lamikagga", "Ola Remo", "Rema", "Zoltanaga"]
    got = {r.name: r.cluster for r in names.name_clusters(spark.createDataFrame([(n,) for n in rows], "name string"), "name").collect()}
    assert len({got[n] for n in rows[:4]}) == 1
    assert len({got[n] for n in rows}) == len(rows) - 3


def test_rare_tokens_decide(spark):
    syllables = "ba ko li ra mu te so vi".split()
    lasts = [a + b + c for a in syllables for b in syllables for c in ("dar", "nik", "sen")]
    rows = [f"{first} {last}" for k, first in enumerate(("Anna", "Anne", "Petra", "Goran")) for last in lasts[k * 30 : k * 30 + 60]]
    rows += [f"{first} Lee" for first in ("Anna", "Anne", "Petra", "Goran", "Ida", "Oto", "Ella", "Hugo", "Mira")] + ["Goran Wikobarus", "Gorqn Wikobarus", "Gorann Wikobarsu"]
    got = {r.name: r.cluster for r in names.name_clusters(spark.createDataFrame([(n,) for n in rows], "name string"), "name").collect()}
    assert len({got[n] for n in rows[-3:]}) == 1
    assert got["Anna Lee"] != got["Anne Lee"]


def test_half_grams_lose_no_typing_error():
    import itertools

    letters = "abcde"
    for word in ("abc", "abcd", "abcde", "abcdeab", "abcdeabc"):
        n = len(word)
        near = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i, c in itertools.product(range(n), letters)}
        near |= {word[:i] + c + word[i:] for i, c in itertools.product(range(n + 1), letters)} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(n - 1)}
        for other in near - {word}:
            assert names.token_grams(word) & names.token_grams(other), (word, other)
