import re

from pyspark.sql import functions as F
from sedimenta.llm import quality_rules as q

from .helpers import odd_documents, table


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_are_those_of_the_definition(spark):
    texts = [None, "", " ", "a b c a b c", "a a a a", "x\n x\nx\n\nx", "a b c d a b c e b c d", "#*$ %&| <> x", "ä b 🙂 c\x0bd", "a b", "a b a b a b\nz\nz"]
    got = q.with_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(t), t


def test_lines_of_many_documents_go_and_depleted_ones_fall(spark):
    own = lambda i, k: " ".join(f"w{i}_{j}" for j in range(k))
    boiler = " ".join(f"b{j}" for j in range(60))
    rows = [(i, f"{own(i, 80)}\n{boiler.upper()}  ", "h", "en", 0) for i in range(30)]  # 60 of 140 words go
    rows += [(100 + i, f"{boiler}\n{own(i + 100, 20)}", "h", "en", 0) for i in range(5)]  # 60 of 80 words go
    rows += [(200, f"{boiler}\n{own(200, 20)}", "other", "en", 0), (300, own(300, 49), "h", "en", 0)]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in q.line_frequency(docs).collect()}
    assert all(got[i].kept and got[i].n_left_words == 80 and got[i].removed_lines == [1] for i in range(30))
    assert all(not got[100 + i].kept and not got[100 + i].base_failed for i in range(5))
    assert got[200].kept and got[200].n_removed_lines == 0 and got[300].base_failed and not got[300].kept
    clean = spark.createDataFrame([("a\n\nb\nc", [0, 2])], "t string, r array<int>").select(q.cleaned(F.col("t"), F.col("r")).alias("c")).first().c
    assert clean == "b"


def test_a_line_at_the_limit_stays(spark):
    text = " ".join(f"b{j}" for j in range(60))
    for n, kept in ((20, True), (21, False)):
        assert {r.kept for r in q.line_frequency(table(spark, [(i, text, "h", "en", 0) for i in range(n)])).collect()} == {kept}


def test_defined_results_for_odd_rows(spark):
    docs = odd_documents(spark)
    got = q.line_frequency(docs)
    assert got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1][0].base_failed
    assert by[6][0].kept and by[6][0].n_words == 30_000 and by[7][0].word_chars == 100_000
    assert by[3][0].n_words == 0 and by[3][0].base_failed
    assert q.line_frequency(docs.limit(0)).count() == 0
