import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat, queries, sql
from millrace.llm.chat import fold, parse, read_back, render
from tests.helpers import assert_same

EVENTS = "conv_id long, message_id long, seq long, kind string, role string, text string"
PARTS = ["<", "\\", "|", "im_start|>", "<|im_end|>\n", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\n", "a", "$1", "%0A", "%", "["]


def messages(spark, *texts, role="assistant"):
    rows = [(1, k, role, x, k) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, role string, text string, first_seq long")
    return df.coalesce(1)


def test_the_log_has_all_kinds_and_folds_to_the_messages(spark):
    rows = [(k % 7, k // 7, ["user", "assistant", None][k % 3], x) for k, x in enumerate([None, "", "a", "é😀", "ab", "</s>", *(f"text {k} of some length" for k in range(80))])] + [(1, 0, "user", "twice")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.recorded(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    got = sorted((r.conv_id, r.first_seq // 8, r.role or "", r.text) for r in fold(log.repartition(5)).collect())
    assert got == sorted((c, t, r or "", x or "") for c, t, r, x in rows)


def test_null_turns_come_first_and_whole(spark):
    texts = [f"some text {k} of a few words" for k in range(12)]
    rows = [(1, None, "assistant", x) for x in texts] + [(1, 0, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = read_back(render(fold(chat.recorded(df)))).collect()
    assert r.n_turns == 13 and r.loss_sha256 == hashlib.sha256("".join([*sorted(texts), "last"]).encode()).hexdigest()


def test_one_shuffle(spark, sf_dir):
    df = queries.op3_chat(spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan


def test_escapes_are_reversible_and_leave_no_control_strings(spark):
    import itertools

    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(PARTS, repeat=n)]
    for r in render(messages(spark, *texts)).collect():
        assert list(parse(r.rendered)) == [("assistant", r.text)]
        inside = r.rendered[len("<|im_start|>assistant\n") : -len("<|im_end|>\n")]
        assert not any(x in inside for x in ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_roles_are_escaped(spark):
    roles = ["user", "a\nb", "%0A", "<|im_end|>\n", "", None, "</s>"]
    df = spark.createDataFrame([(1, k, x, "hi", k) for k, x in enumerate(roles)], "conv_id long, message_id long, role string, text string, first_seq long")
    for r in render(df).collect():
        assert list(parse(r.rendered)) == [(r.role or "", "hi")]


def test_fold(spark):
    log = [
        (1, 10, 1, "message", "user", "hello"),
        (1, 11, 2, "delta", "assistant", "a"), (1, 11, 3, "delta", None, "b"), (1, 11, 3, "delta", None, "b"),
        (1, 11, 4, "regenerate", None, None), (1, 11, 6, "delta", None, "d"), (1, 11, 5, "delta", None, "c"),
        (1, 10, 7, "edit", None, "hello!"), (1, 12, 8, "message", "user", "x"), (1, 12, 9, "delete", None, None),
        (2, None, 1, None, None, None), (None, 1, None, "other", "user", "y"),
    ]
    got = {(r.conv_id, r.message_id): (r.role, r.text, r.first_seq) for r in fold(spark.createDataFrame(log, EVENTS).repartition(5)).collect()}
    assert got == {(1, 10): ("user", "hello!", 1), (1, 11): ("assistant", "cd", 2), (2, None): (None, "", 1), (None, 1): ("user", "y", None)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(chat.KINDS), st.text("ab", max_size=2)), max_size=8))
def test_fold_equals_replay(spark, log):
    state = None
    for kind, text in log:
        state = {"message": text, "edit": text, "delta": (state or "") + text, "regenerate": text, "delete": None}[kind]
    deleted = bool(log) and [k for k, _ in log if k != "delta"][-1:] == ["delete"]
    rows = spark.createDataFrame([(1, 1, k, kind, "user", text) for k, (kind, text) in enumerate(log)], EVENTS)
    got = [r.text for r in fold(rows).collect()]
    assert got == ([] if deleted or not log else [state])


def test_read_back_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        texts = [f"t{k}</s>" for k in range(20)]
        (r,) = read_back(render(messages(spark, *texts))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (r.n_turns, r.loss_chars) == (20, sum(map(len, texts)))
    assert r.loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest()
    assert read_back(render(messages(spark, "x").limit(0))).collect() == []


def test_hard_rows(spark, tmp_path):
    rows = [(1, 0, "user", None, "q"), (1, 0, "user", None, "q"), (1, 1, None, "x" * 200_000, "q"), (None, None, "assistant", "", "q"), (2, 5, "assistant", "é😀", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in queries.op3_chat(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0), None: (1, 0), 2: (1, 2), -7: (2, 21)}


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op3_chat(spark, sf_dir), sql.OP3, sf_dir)
