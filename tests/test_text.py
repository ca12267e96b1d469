import pytest
from pyspark.sql import functions as F

from voxgraph.functions import nested, text, urls


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


def test_blanks_and_words(spark):
    assert one(spark, text.collapse_blanks(F.col("a")), a=" x  y\n") == "x y" and one(spark, text.collapse_blanks(F.col("a")), a=None) == ""
    assert one(spark, text.word_count(F.col("a")), a="L'élan n'est pas_là 12") == 6
    assert one(spark, text.compact(F.col("a"), 2), a="1 2 3 4 5") == "1 2 [...] 4 5" and one(spark, text.compact(F.col("a"), 2), a=" 1 2 3 4 ") == "1 2 3 4"


def test_phases(spark):
    x = "Café 日本🙂"
    assert one(spark, text.phase_text(F.col("a"), "A"), a=x) == x.lower().encode().decode("latin-1")
    for p, limit, low in (("B", 256, True), ("C", 128, True), ("D", 128, False)):
        assert one(spark, text.phase_text(F.col("a"), p), a=x) == "".join(c if ord(c) < limit else "?" for c in (x.lower() if low else x))
    assert one(spark, text.phase_text(F.col("a"), "E"), a=x) == x and one(spark, text.phase_text(F.col("a"), "A"), a=None) is None


@pytest.mark.parametrize("day,phase", [("2008-09-01", "A"), ("2010-07-13T10", "A"), ("2010-07-14", "B"), ("2013-04-28", "C"), ("2014-05-21", "D"), ("2020-04-30", "E"), ("2020-05-01", None), ("2010", None), (None, None)])
def test_phase_of_date(spark, day, phase):
    assert one(spark, text.phase_of_date(F.col("a")), a=day) == phase


@pytest.mark.parametrize("damaged,candidate,match,fills", [("beyonc?", "Beyoncé", True, True), ("a?b", "axb", True, False), ("a?b", "a’b", True, True), ("ab", "A.b", True, False), ("a%?", "a%é", True, True), ("a_?", "axé", False, False), ("a?", "abé", False, False)])
def test_wildcards(spark, damaged, candidate, match, fills):
    assert one(spark, text.wildcard_match(F.col("a"), F.col("b")), a=damaged, b=candidate) is match
    assert one(spark, text.fills_encoding(F.col("a"), F.col("b")), a=damaged, b=candidate) is fills


def test_case(spark):
    assert one(spark, text.sentence_truecase(F.col("a")), a="“he came. 2 saw! x?y") == "“He came. 2 Saw! X?Y"
    assert one(spark, text.all_lower(F.col("a")), a="[MASK] said") is True and one(spark, text.all_lower(F.col("a")), a="12") is False and one(spark, text.all_lower(F.col("a")), a=None) is True and one(spark, text.equals_lower(F.col("a")), a="12") is True


def test_majority(spark):
    pick = lambda *w: spark.range(1).select(text.majority(F.array(*map(F.lit, w)))).first()[0]
    assert pick("a", "b", "b") == "b" and pick("a", "b", "c") == "a" and pick("a", "b", "b", "a") == "a"
    assert spark.range(1).select(text.majority(F.array().cast("array<string>"))).first()[0] is None


def test_tokens(spark):
    assert one(spark, F.array_join(text.speaker_tokens(F.col("a"), ["mr", "dr"]), "|"), a="Mr. J. O'Neil-Smith") == "j|o'neil-smith"
    assert one(spark, F.array_join(text.drop_punctuation(F.split("a", " ")), " "), a="He 's [MASK] , n't here .") == "He [MASK] here"
    assert one(spark, text.rebuild_brackets(F.col("a")), a="a [ TARGET ] b") == "a [TARGET] b"
    assert one(spark, text.mark_span(F.split("a", " "), F.lit(1), F.lit(3)), a="a b c d") == "a << b c >> d"
    assert one(spark, text.nearest_verb(F.col("a"), F.col("b"), ["said", "added"]), a="x added y said", b="added") == "said"
    assert one(spark, text.unwrap_json(F.col("a")), a='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.normal_answer(F.col("a")), a=" “x”  Y. ") == "“x” y" and one(spark, text.normal_answer(F.col("a")), a="Unknown") == ""


@pytest.mark.parametrize("url,domain", [("http://news.bbc.co.uk/x", "bbc.co.uk"), ("https://www.a.example:80/x?y", "a.example"), ("nonsense", None), ("http://localhost/", None), ("http://1.2.3.4/", None), (None, None), ("http://co.uk/", None)])
def test_registered_domain(spark, url, domain):
    assert one(spark, urls.registered_domain(F.col("a")), a=url) == domain


def test_url_rewrites(spark):
    assert one(spark, urls.strip_tracking(F.col("a")), a="http://a.example/x?utm_source=f&id=3&Ref=1#t") == "http://a.example/x?id=3#t"
    assert one(spark, urls.strip_tracking(F.col("a")), a="http://a.example/x?id=3") is None
    assert one(spark, urls.unwrap_embedded(F.col("a")), a="http://c.example/r?40=http%3A%2F%2Fb.example%2Fy") == "http://b.example/y"
    assert one(spark, urls.unwrap_redirect(F.col("a")), a="http://rd.yahoo.com/z/*http%3A//b.example/y") == "http://b.example/y"
    assert one(spark, urls.strip_query(F.col("a")), a="http://a.example/20100714/x?p=1") == "http://a.example/20100714/x" and one(spark, urls.strip_query(F.col("a")), a="http://a.example/x?p=1") is None
    v = one(spark, urls.variants(F.col("a")), a="http://www.a.example/12345?utm_x=1")
    assert [x.label for x in v] == ["orig", "no_tracking", "no_tracking_https", "no_tracking_bare"] and len({x.url for x in v}) == len(v)
    assert one(spark, urls.is_blocked(F.col("a")), a="http://www.x.wordpress.com/") is True and one(spark, urls.is_blocked(F.col("a")), a="http://wordpress.com.example/") is False
    assert one(spark, urls.archive_page(F.col("a")), a="https://web.archive.org/web/20100101000000/http://a") == "https://web.archive.org/web/20100101000000id_/http://a"


def test_knowledge_base(spark):
    item = '{"id":"Q1","aliases":{"en":[{"language":"en","value":"A"},{"language":"en","value":"B"}]},"labels":{"en":{"value":"L"}},"claims":{"P31":[{"mainsnak":{"datavalue":{"type":"wikibase-entityid","value":{"entity-type":"item","numeric-id":5}}}},{"mainsnak":{}}],"P1":[{"mainsnak":{"datavalue":{"type":"string","value":"x"}}}]},"sitelinks":{"enwiki":{"title":"T"}}}'
    df = spark.createDataFrame([(item,), ("{}",), (None,)], "instance string")
    p = nested.project_item(F.col("instance"))
    rows = df.select(nested.alias_list(p["aliases"]).alias("a"), nested.label_value(p["label"]).alias("l"), nested.item_statements(p["claims"]).alias("s"), nested.sitelink_titles(p["sitelinks"]).alias("t")).collect()
    assert rows[0].a == ["A", "B"] and rows[0].l == "L" and [tuple(x) for x in rows[0].s] == [("P31", "Q5")] and [tuple(x) for x in rows[0].t] == [("enwiki", "T")]
    assert rows[1].a == [] and rows[2].l == "" and rows[2].s == [] and rows[2].t == []


def test_top_speaker(spark):
    rows = [("A", [("A", "Q1", 0.5), ("A", "Q2", 0.5), ("B", "Q3", 0.9)]), ("C", [("A", "Q1", 0.5), ("B", "Q3", 0.5)]), ("C", [])]
    df = spark.createDataFrame(rows, "n string, p array<struct<speaker string, qid string, probability double>>")
    got = [tuple(r.x) for r in df.select(nested.top_speaker(F.col("n"), F.col("p")).alias("x")).collect()]
    assert got == [("A", "Q2", 0.5), ("A", "Q1", 0.5), ("C", None, 0.0)]


def test_dump_text(spark):
    from voxgraph.functions import dump

    x = "`` They do n't like the world 's '' , he said ( twice ) . var a = escape ( 'x' ) ; < br /> hello''x Share this: foo"
    assert one(spark, dump.clean_dump(F.col("a")), a=x) == "“They don't like the world”'s, he said (twice). hello” x"
    assert one(spark, dump.clean_dump(F.col("a")), a=" ") == "" and one(spark, dump.clean_dump(F.col("a")), a=None) == ""
    assert one(spark, F.array_join(dump.split_punctuation(F.split("a", " ")), " "), a="(Mr. Lee, [MASK] Bob's boys' end.") == "Lee , [MASK] Bob 's boys ' end ."
    assert one(spark, dump.canonical_candidate(F.col("a")), a=" Britain 's Prime Minister Gordon Brown, who ") == "Gordon Brown"
    assert one(spark, dump.canonical_candidate(F.col("a")), a="Labour leader Ed Miliband") == "Ed Miliband"
    assert one(spark, F.array_join(dump.speaker_candidates(F.col("a"), ["he"]), "|"), a="He met Mr. Ann Lee and Ann Lee today") == "Mr. Ann Lee|Ann Lee"
    assert one(spark, dump.is_name_smash(F.col("a"), F.col("b")), a="Beyonc?s", b="Beyoncés") is True and one(spark, dump.is_name_smash(F.col("a"), F.col("b")), a="caf?", b="café") is False
    assert one(spark, dump.encoding_match(F.col("a"), F.col("b")), a="CAFÉ", b="café") is True and one(spark, dump.encoding_match(F.col("a"), F.col("b")), a="cafÃ©", b="café") is False
