import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import chunk, parse, text, vector
from scriptorium.operators import dedupe, keyword


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_strip_and_cleaners(spark):
    raw = "Search\n  sign in \n7\n||\n  A  line \n\n\n*#!~\nII\nCHAPTER  ONE\n3 Constitution of Kenya text"
    assert one(spark, text.strip(F.col("t")), t="  x\t\n") == "x"
    assert one(spark, text.clean_web(F.col("t")), t=raw) == "||\nA line\n*#!~\nII\nCHAPTER ONE\n3 Constitution of Kenya text"
    assert one(spark, text.clean_ocr(F.col("t")), t=raw) == "A line\nII\nCHAPTER ONE\n3 Constitution of Kenya text"
    assert one(spark, text.clean_statute(F.col("t")), t=raw) == "A line\nCHAPTER ONE\ntext"
    assert one(spark, text.cleaned_or_raw(F.lit(" "), F.lit("raw"))) == "raw"


def test_strip_takes_any_white_space(spark):
    df = spark.createDataFrame([("\u00a0\u2003 x y\u00a0",), ("\x0b\x0cx y\r\n",), ("\u3000",), ("",), (None,), ("x\u2028y",)], "t string")
    assert [r.x for r in df.select(text.strip(F.col("t")).alias("x")).collect()] == ["x y", "x y", "", "", None, "x\u2028y"]


def test_paragraphs_up_to_the_size(spark):
    cut = lambda *sizes: [len(x) for x in one(spark, chunk.paragraphs(F.col("t")), t="\n\n".join("x" * n for n in sizes))]
    assert cut(600, 400) == [1002] and cut(600, 401) == [600, 603] and cut(1200, 10) == [1200, 212]


def test_hashes_and_names(spark):
    assert one(spark, text.text_hash(F.lit(""))) == ""
    assert one(spark, text.text_hash(F.lit("a"))).startswith("ca978112")
    assert one(spark, text.stem(F.lit("/x/y.z/name.tar.pdf"))) == "name.tar"
    assert one(spark, text.stem(F.lit("plain"))) == "plain"
    assert one(spark, text.preview(F.lit("abcdef"), 3)) == "abc..."


def test_sentences(spark):
    said = "Dr. Who came. He left! Really? Yes."
    assert one(spark, text.sentences(F.lit(said))) == ["Dr. Who came.", "He left!", "Really?", "Yes."]
    assert one(spark, text.sentences(F.lit(said), legacy=True)) == ["Dr. Who came. He left!", "Really?", "Yes."]


@pytest.mark.parametrize("n", [0, 1, 300, 999, 1000, 1001, 5000])
def test_recursive_pieces_are_where_they_say(n):
    r = random.Random(n)
    t = "".join(r.choice(["word ", "longer. ", "\n", "\n\n", "x"]) for _ in range(n // 4))
    size, overlap = chunk.sizes_for(len(t))
    pieces = chunk.split_recursive(t, size, overlap)
    assert all(t[s : s + len(c)] == c and len(c) <= size for s, c in pieces)
    assert [s for s, _ in pieces] == sorted(s for s, _ in pieces)
    seen = set()
    for s, c in pieces:
        seen |= set(range(s, s + len(c)))
    assert all(t[i].isspace() for i in set(range(len(t))) - seen)


def test_article_windows_end_at_spaces_and_go_on():
    t = "ab " * 1000
    cut = chunk.cut_article(t)
    assert all(len(c) <= 1000 for c in cut) and cut[0].endswith("ab")
    long_token = "x" * 4000
    assert len(chunk.cut_article(long_token)) < 8
    assert chunk.cut_article("short") == ["short"]
    assert len(chunk.cut_article(t[:1800], trim_tail=True)) <= len(chunk.cut_article(t[:1800]))


def test_paragraphs(spark):
    t = "\n\n".join(["a" * 600, "b" * 600, "c" * 2000])
    got = one(spark, chunk.paragraphs(F.lit(t)))
    assert got == ["a" * 600, "a" * 200 + "\n\n" + "b" * 600, "b" * 200 + "\n\n" + "c" * 2000]
    assert one(spark, chunk.paragraphs(F.lit(""))) == []


def test_sentence_chunks():
    assert chunk.sentence_chunks(["s"] * 10, [100] * 10, 500, 800, 20) == [(0, 8, 800)]
    assert chunk.sentence_chunks(["s"] * 15, [100] * 15, 500, 800, 20) == [(0, 8, 800), (7, 15, 800)]
    assert chunk.sentence_chunks(["s"], [499], 500, 800, 20) == []


def test_case_fields_last_value_wins(spark):
    got = one(spark, parse.case_fields(F.lit("Court: a\nCOURT LEVEL - b\nYEAR - 2002\n**JUDGE:** x\nnonsense")))
    assert (got.court_level, got.year, got.judge, got.parties) == ("b", "2002", "", "")
    assert one(spark, parse.case_fields(F.lit(None).cast("string"))).file_name == ""


def test_sections_missing_header_runs_on(spark):
    got = one(spark, parse.sections(F.lit("## SECTION 1: FACTS\nf\nSECTION 3: RULES\nr")))
    assert got.facts == "f\nSECTION 3: RULES\nr" and got.rules == "r" and got.issues == ""


def test_sections_after_characters_of_two_units(spark):
    # places in a text count characters, not the halves of those beyond 16 bits
    got = one(spark, parse.sections(F.lit("\U0001f600\U0001f600\U0001f600 # SECTION 1: FACTS\nf \U0001f600\nSECTION 3: RULES r\n\n\n\n## SECTION 1: FACTS g\nsection 2 - issues\ni")))
    assert (got.facts, got.rules, got.issues) == ("f \U0001f600\nSECTION 3: RULES r\n\n g", "r\n\n## SECTION 1: FACTS g\nsection 2 - issues\ni", "i")


def _plan(spark, column):
    return spark.range(1).select(F.col("id").cast("string").alias("t")).select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_and_replies_are_cut_once(spark):
    # every field cut the block again, and every section looked through the reply again
    assert _plan(spark, parse.case_fields(F.col("t"))).count("split(") == 1
    assert _plan(spark, parse.sections(F.col("t"))).count("METADATA") == 2  # the headers, and the texts between them


def test_classification_forms(spark):
    got = one(spark, parse.classification(F.lit('```json\n{"legal_domains":["a",{"domain":"b","confidence_score":0.9}],"vector_query":"q"}\n```')))
    assert [(d.domain, d.confidence_score) for d in got.legal_domains] == [("a", 0.5), ("b", 0.9)]
    assert one(spark, parse.missing_keys(F.lit("no json"))) == list(parse.REQUIRED)


def test_extracted_articles_null_for_no_json(spark):
    assert one(spark, parse.extracted_articles(F.lit("no"))) in (None, [])
    assert one(spark, parse.extracted_articles(F.lit('[{"article_no": 3, "keywords": ["k"]}]')))[0].article_no == 3


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vector.cosine(a, a)) == pytest.approx(1)
    assert one(spark, vector.cosine(a, b)) == 0
    assert one(spark, vector.std(a)) == pytest.approx(0.5)


def test_domain_boost(spark):
    wanted = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(c).alias("confidence_score")) for d, c in (("criminal law", 0.9), ("constitutional law", 0.7))])
    assert one(spark, vector.domain_boost(F.lit("Criminal Law"), wanted)) == pytest.approx(0.9)
    assert one(spark, vector.domain_boost(F.lit(""), wanted)) == 0
    assert one(spark, vector.domain_boost(F.lit("law"), wanted)) == pytest.approx(0.8)


def test_greedy_dedupe_threshold_is_exclusive(spark):
    base = [f"w{i}" for i in range(10)]
    rows = [(1, 1, 1, " ".join(base)), (1, 2, 2, " ".join(base[:7] + ["a", "b", "c"])), (1, 3, 3, " ".join(base[:8] + ["d", "e"])), (1, 4, 4, "")]
    df = spark.createDataFrame(rows, "g int, r int, i int, t string")
    assert sorted(r.i for r in dedupe.greedy(df, group="g", rank="r", id="i", text="t").collect()) == [1, 2, 4]


def test_hybrid_flat_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.4, 0.0), (1, 2, 0.4, 0.0), (2, 3, 0.3, 0.9)], "q int, i int, semantic double, keyword double")
    got = {r.i: r.hybrid for r in keyword.hybrid(df, query="q").collect()}
    assert got == {1: pytest.approx(0.7), 2: pytest.approx(0.7), 3: pytest.approx(0.3)}


def test_chunks_of_a_batch_are_not_held_as_objects():
    import tracemalloc

    tracemalloc.start()
    made = chunk._lists(([(i, f"{i:08d}" * 100)] * (i % 3) for i in range(30_000)), chunk.PIECE_FIELDS)
    peak = tracemalloc.get_traced_memory()[1]  # Python's objects; Arrow's memory is not among them
    tracemalloc.stop()
    assert peak < 8 << 20 and len(made) == 30_000 and made[0].as_py() == []
    assert made[29_998].as_py() == [{"start": 29_998, "text": "00029998" * 100}]
