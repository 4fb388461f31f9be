import pytest

from skarn.llm import pii

LEXICON = {"Drolud": "given", "Elirah": "given", "Kylah": "given", "Hushari": "family", "Morlund": "family", "Zélolter": "family", "Keskirari": "family"}
COMMON = ["the", "and", "please", "every", "pin", "call", "ship", "office", "keep", "parser", "module"]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(LEXICON, COMMON)


def marked(finder, text):
    """The text with its cases, for example ``<name:Drolud>``."""
    out, at = [], 0
    for s, e, k in finder.find(text):
        out += [text[at:s], f"<{k}:{text[s:e]}>"]
        at = e
    return "".join([*out, text[at:]])


CASES = [
    "mail <email:a.b+tag@lab.example.org>, or mailto:<email:x@dev.invalid>.", "to <<email:DROLUD@MAIL.EXAMPLE>>;", "caller=<email:a_b [at] corp [dot] example> peer=10.1.2.3", "<email:a-b AT lab DOT example DOT org> now", "<email:a(at)b.example> and <email:c @ d.example>",
    "git@code.search.invalid:cache/binder.git", "npm install @cache/binder@6.1.0", "@Injectable()\nclass A", "ssh://git@host.example/x", "at 10 dot",
    "call <phone:+1-782-555-0177 ext. 628>.", "tel=<phone:+44 (0)20 7946 0564>;", "(<phone:(390) 555-0196>)", "<phone:882.555.0119> or <phone:+18455550103>", "<phone:0049-30-23125852>, <phone:+33 1 99 00 98 66>", "电话:<phone:+61-2-5550-5462>。",
    "10.132.217.188:5555", "2025-09-05T01:14:09Z", "v3.12.1 of 7.66.2697.670", "lines 1360-1422", "id 8a50015a-40a1-4e62-8703-031069ed1dcb", "took 17665ms",
    "SSN <id_number:967 26 8376> The walk stops", "took 12 The way is", "SSN <id_number:967 26 8376>", "was <id_number:939-25-4208>.", "social security number <id_number:950447637> at the desk", "NI number <id_number:QQ117045B>,", "<id_number:QQ 36 89 35 B>", "passport no. <id_number:X97944853>", "driver's licence <id_number:D221-6042-6280>", "id=<id_number:0508 9583 7752> x",
    "home <address:219 Ferry Court>. The", "home <address:204 Old Quarry Lane>. cc x", "to <address:9 Tannery Dr.> by", "at <address:44 Old Quarry Lane #14, Quarry Bay Falls, ZZ 91230>.", "to <address:97 Alumdale Ave, Suite 210> by Friday", "<address:P.O. Box 8778, Quarry Bay Falls>.", "à <address:212 rue des Tilleuls, 19216 Nord Harrow>.", "an <address:Alte Mühlstraße 133a, 95880 Lintmoor>.", "a <address:Avenida Mayor del Faro 217, 40186 Lintmoor>.", "home <address:Am Steinbruch 15a, 12778 Quarry Bay>, x",
    "Thanks to <name:Drolud>'s note", "ask <name:Elirah M. Hushari> before", "cc <name:E. Morlund> / <name:KYLAH ZÉLOLTER> / <name:Drolud> Pin it", "<name:Hushari, Elirah> wrote", "Dr. <name:Morlund-Hushari> first", "The Hushari parser is slower", "`HushariRegistry` and hushari_x", "by <name:drolud morlund> now", "cc <name:Kylah> <name:elirah hushari>'s patch", "with <name:Elirah\nKeskirari>.", "<name:Drolud  Morlund> <<email:d.morlund@x.example>>",
    "", " ", "nothing here",
    "aan <address:Keizersgracht 12, 1015 CJ Amsterdam>.", "ring <phone:01 42 68 53 00> or <phone:07700 900123>", "see 14 Garden, and 12 Table View of it", "build 020 7946 0958 passed",
]


@pytest.mark.parametrize("want", CASES)
def test_bounds(finder, want):
    import re

    text = re.sub(r"<(?:email|phone|id_number|address|name):([^>]*)>", r"\1", want)
    assert marked(finder, text) == want


OTHER_TEXT = [
    "phone <name:Rajesh Venkataraman> on <phone:020 7946 0958>", "at <address:14 Elm Gardens, Leeds LS1 4AB>", "in <address:Via Roma 12, 00184 Roma>", "driver license <id_number:D12345678>", "<name:Aiko Tanaka> and <name:Oluwaseun Adebayo>", "version 1234 5678 9012",
]


def test_text_of_another_kind():
    """Cases in text that isn't from the tables, found with the lexicon and the common words of the tables."""
    import re

    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    lex = pq.read_table(f"{d}/name_lexicon.parquet").to_pydict()
    texts = [t for t in pq.read_table(f"{d}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    lex = dict(zip(lex["token"], lex["name_part"]))
    finder = pii.Finder(lex, pii.common_words(texts, lex))
    for want in OTHER_TEXT:
        assert marked(finder, re.sub(r"<(?:email|phone|id_number|address|name):([^>]*)>", r"\1", want)) == want


def test_offsets_count_code_points_and_mask(spark):
    df = spark.createDataFrame([(1, "😀 mail a@b.example 😀", "x"), (2, None, "x"), (3, "", "x"), (1, "😀 mail a@b.example 😀", "x")], "doc_id bigint, text string, key string")
    lex = spark.createDataFrame(list(LEXICON.items()) + [(None, None)], "token string, name_part string")
    got = [tuple(r) for r in pii.find_cases(df, "doc_id", "text", lex).collect()]
    assert got == [(1, 7, 18, "email")] * 2
    masked = {(r.doc_id, r.text) for r in pii.mask(df, "doc_id", "text", lex).collect()}
    assert masked == {(1, "😀 mail [EMAIL] 😀"), (2, None), (3, "")}
    assert pii.find_cases(df.limit(0), "doc_id", "text", lex.limit(0)).count() == 0


def test_lexicons_that_differ_late_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "ask Zuleqor about it"), (2, "Thanks to Vantiro's note")], "doc_id bigint, text string")
    first = [(f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}", "given") for i in range(60)]
    for last in ("Zuleqor", "Vantiro"):
        lex = spark.createDataFrame([*first, (last, "given")], "token string, name_part string").coalesce(1)
        got = {(r.doc_id, r.pii_type) for r in pii.find_cases(docs, "doc_id", "text", lex).collect()}
        assert ((1 if last == "Zuleqor" else 2), "name") in got


def test_lexicon_beyond_the_limit(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Thanks to Zuleqor Vantiro's note"), (2, "nothing"), (3, None), (3, "")], "doc_id bigint, text string")
    first = [(f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}", "given") for i in range(60)]
    lex = spark.createDataFrame([*first, ("Zuleqor", "given"), ("Vantiro", "family")], "token string, name_part string")
    want = [tuple(r) for r in pii.find_cases(docs, "doc_id", "text", lex).collect()]
    read = pii.read_lexicon
    monkeypatch.setattr(pii, "read_lexicon", lambda df: read(df, limit=20))
    assert pii.read_lexicon(lex)[1] is not None and [tuple(r) for r in pii.find_cases(docs, "doc_id", "text", lex).collect()] == want == [(1, 10, 25, "name")]


def test_other_words_count_all_rows(spark):
    texts = [f"every pin {'keeps' if i < 30 else 'drops'} rows {i}, word{'abcdefghij'[i % 10] * 3} stays" for i in range(5_000)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    # 25 of 5,000 rows are the least number: counted in all of them, not in some.
    assert pii.other_words(df, "text", {"Pin": "given"}) == pii.common_words([t for t in texts if t], {"Pin": "given"})
    more = spark.createDataFrame([("drops", "family")], "word string, part string")
    assert "keeps" in pii.other_words(df, "text", {}) and "drops" not in pii.other_words(df, "text", {}, more)


def test_trigrams_of_a_large_lexicon(spark):
    lex = {k.lower(): v for k, v in LEXICON.items()}
    counted = pii.gram_counts(spark.createDataFrame([*lex.items(), ("", "given")], "word string, part string"))
    whole, some = pii.NameModel(LEXICON, COMMON), pii.NameModel({"Drolud": "given"}, COMMON, counted)
    assert whole.weights == some.weights and whole.family_weights == some.family_weights and whole.unseen == some.unseen


def test_many_cases_in_one_text(finder):
    import time

    t = time.process_time()
    assert len(finder.find("mail a.b@c.example, " * 20_000)) == 20_000 and time.process_time() - t < 20


def test_longest_stands():
    assert pii.longest([(0, 5, "name"), (0, 9, "address"), (8, 12, "phone"), (20, 22, "name")]) == [(0, 9, "address"), (20, 22, "name")]


def test_long_text(finder):
    text = ("every module keeps 12 rows, 555 " * 40_000) + "call +1-782-555-0177"
    assert finder.find(text)[-1][2] == "phone"
    assert finder.find("@" * 20_000 + "1" * 20_000 + "-" * 20_000 + " A" * 20_000) is not None
