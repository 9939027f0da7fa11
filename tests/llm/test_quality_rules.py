import re
from collections import Counter

from millrace.llm import quality_rules, queries, sql
from millrace.llm.quality_rules import ablation, ledger, mask, passes
from tests.helpers import assert_same
from tests.llm.conftest import HARD, PROSE


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


MORE = ["a b c a b c", "a a a a", "a b c d a b c", "x y\nx y\n \nx y", "a b", "# * $ % & | < >", "AB CD ef", " a b c\ta b c "]


def test_measures_equal_brute_force(docs):
    texts = [*HARD, *MORE]
    for r in ledger(docs(*texts, clashing=True)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_hard_rows(docs):
    clean = ". ".join(PROSE.split(" again")[0] + f" {k}" for k in ("one two three", "four five six")) + "."
    rows = ledger(docs((None, clean), (1, PROSE), (1, PROSE), (2, None))).collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2]
    assert rows[3].failed == mask("base-1") & 1
    assert ledger(docs("x").limit(0)).collect() == []


def test_filters_are_not_pushed_into_the_measures(docs):
    rows = ledger(docs(*["w%d " % k * 3000 for k in range(40)])).where(passes("prose-1")).where("n_words > 10")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") < plan.index("xxhash64")
    rows.collect()


def test_ablation(docs):
    texts = [PROSE * 3, "a b", "! " * 60, " ".join(f"word{k}" for k in range(60)) + " ###########"]
    rows = ledger(docs(*texts))
    got = {r.rule: (r.n_failing, r.n_only) for r in ablation(rows, "prose-1").collect()}
    bits = [r.failed & mask("prose-1") for r in rows.collect()]
    for b, (name, _) in enumerate(quality_rules.RULES):
        if name in got:
            assert got[name] == (sum(x >> b & 1 for x in bits), sum(x == 1 << b for x in bits))
    assert got["symbols"] == (1, 1)


def test_clean_labelled_documents_are_kept(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op4_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) == 0


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op4_quality_rules(spark, sf_dir), sql.OP4, sf_dir)
