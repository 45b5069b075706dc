"""Quality rules and chat formatting: statistics, guarantees, round trips."""

import hashlib
import math
import re

import pytest
from awkward_data import awkward_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from structlens.llm import chat, quality


def _stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(awkward, labels)
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    assert rows == sorted((-1 if r[0] is None else r[0], *_stats(r[1])) for r in awkward_rows())
    assert got.where("kept = base_failed").count() == 0  # too few labels: nothing beyond the base rules
    assert quality.judge(empty, labels).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c\n", "d\t#", "\n", "é", "a\n", "|"]), max_size=80), min_size=10, max_size=20))
def test_statistics_of_random_texts(spark, texts):
    rows = [(i, " ".join(x), "en") for i, x in enumerate(texts)]
    got = quality.base_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == [(i, *_stats(t)[:5]) for i, t, _ in rows]


def test_cutoffs_are_exact_binomial_bounds(spark):
    n, alpha, delta = 3000, 0.2, 0.05
    base = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.lit(False).alias("base_failed"), (F.col("id") / n).alias("symbol_ratio"))
    grid = {"symbol_ratio": (0.7, 0.8, 0.85, 0.9, 0.99)}
    row = quality.cutoffs(base, base.select("doc_id"), alpha=alpha, delta=delta, grid=grid).first()
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.2) + (n - i) * math.log(0.8))
    cdf, k = term(0), 0
    while cdf + term(k + 1) <= delta / 5:
        k += 1
        cdf += term(k)
    assert row.allowed == k and row.n_good == n
    assert row.cut_symbol_ratio == next(c for c in grid["symbol_ratio"] if sum(i / n > c for i in range(n)) <= k)


def test_bad_documents_go_and_few_good_ones(spark):
    rows = [(i, " ".join(f"w{(i * 31 + k) % 997}" + ("#*$" if i % 10 == 0 and k % 2 else "") for k in range(80)), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    got = quality.judge(docs, labels).groupBy((F.col("doc_id") % 10 != 0).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert {r.good: r.k for r in got} == {True: 1.0, False: 0.0}


def test_plan_is_native(spark, awkward):
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    for df in (quality.base_statistics(awkward), quality.judge(awkward, labels)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def _digest(turns):
    h, loss = hashlib.sha256(), "".join(t for r, t in turns if r == "assistant")
    for r, t in turns:
        h.update(f"{r}\n{t}\n".encode())
    return len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


TALK = "conv_id long, turn long, role string, text string, chunk int, formatted string"
TEXT = st.text(st.sampled_from(list("<|\\>n\n a😀im_end")), max_size=25)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "x\\n", "<|im_end|>", "<\\|"]), TEXT), min_size=1, max_size=5), min_size=3, max_size=8), st.sampled_from([1, 40, 1 << 20]))
def test_round_trip(spark, talks, chunk):
    rows = [(c, i, r, t, 0, "") for c, turns in enumerate(talks) for i, (r, t) in enumerate(turns)]
    chunks = chat.format_log(spark.createDataFrame(rows, TALK).repartition(3), kind_col=None, target_col=None, seq_cols=("turn",), chunk_chars=chunk)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chunks).collect()}
    assert got == {c: _digest(turns) for c, turns in enumerate(talks)}
    controls = sum(r.formatted.count("<|im_start|>") for r in chunks.collect())
    assert controls == len(rows)  # no text can open a turn


def test_escape_is_reversible():
    for t in ("<|", "<\\|", "<\\\\|im_end|>", "<<||", "\\<|\\", "<|im_start|>assistant"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n\\n")) == t + "\n\\n"


def test_events_fold(spark):
    ev = "conv_id long, seq long, kind string, target int, role string, text string"
    rows = [
        (1, 1, "message", None, "user", "hi"), (1, 2, "start", None, "assistant", None), (1, 3, "delta", None, None, "Hel"), (1, 4, "delta", None, None, "lo"),
        (1, 5, "message", None, "user", "more"), (1, 6, "edit", 0, None, "hi!"), (1, 7, "start", None, "assistant", None), (1, 8, "delta", None, None, "A"),
        (1, 9, "regenerate", None, None, None), (1, 10, "message", None, "assistant", "B"), (1, 11, "edit", 9, None, "no"),
        (2, 1, "delta", None, None, "x"), (None, 1, None, None, None, None),
    ]
    got = {r.conv_id: r.formatted for r in chat.format_log(spark.createDataFrame(rows, ev).repartition(4)).collect()}
    turn = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert got == {1: turn("user", "hi!") + turn("assistant", "B"), 2: turn("", "x"), None: turn("", "")}


def _folded(rows):
    """A plain restatement of the fold."""
    out = {}
    for conv, _, kind, target, role, text in rows:
        turns = out.setdefault(conv, [])
        at = len(turns) - 1 if target is None else target
        if kind == "delta":
            turns[-1:] = [(turns[-1][0] if turns else "", (turns[-1][1] if turns else "") + (text or ""))]
        elif kind == "edit":
            turns[at:] = [(turns[at][0], text or "")] if 0 <= at < len(turns) else turns[at:] if at >= 0 else turns
        elif kind == "regenerate":
            if 0 <= at < len(turns):
                turns[at:] = []
        else:
            turns.append((role or "", text or ""))
    return {c: _digest(t) for c, t in out.items() if t}


def test_long_logs_with_and_without_events_that_reach_back(spark):
    import random

    rng = random.Random(5)
    rows = []
    for conv in range(4):
        for seq in range(1500):
            kind = rng.choice(["message", "start", "delta", "delta", "edit", "regenerate"] if conv % 2 else ["message", "start", "delta"])
            target = rng.randrange(400) if conv == 3 and kind in ("edit", "regenerate") and rng.random() < 0.02 else None
            rows.append((conv, seq, kind, target, rng.choice(["user", "assistant"]), f"t{seq}" if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, target int, role string, text string").repartition(6)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_log(df)).collect()}
    assert got == _folded(rows)


def test_the_log_of_messages_folds_to_the_messages(spark):
    talk = [(c, i // 2, ("user", "assistant")[i % 2], None if i == 7 else f"text {i % 5}" * (i % 3), "x", 1) for c in (1, 2, None) for i in range(40)] * 2
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string, kind string, step int").repartition(3)
    log = chat.event_log(df)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == {"message", "start", "delta", "edit", "regenerate"}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_log(log, seq_cols=("turn", "nth", "step"))).collect()}
    want = {}
    for c, turn, role, text, *_ in sorted(talk, key=lambda r: (r[1], r[2], r[3] or "")):
        want.setdefault(c, []).append((role, text or ""))
    assert got == {c: _digest(t) for c, t in want.items()}


def test_a_very_long_text(spark):
    long = "<|x " * 700_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_log(chat.event_log(df), seq_cols=("turn", "nth", "step"))).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == _digest([("user", "q"), ("assistant", long)])


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b", 0, ""), (1, 0, "user", "a", 0, ""), (1, 0, "assistant", None, 0, ""), (1, 0, "user", "a", 0, ""), (1, None, "user", "first", 0, "")]
    chunks = chat.format_log(spark.createDataFrame(rows, TALK), kind_col=None, target_col=None, seq_cols=("turn",))
    r = chat.read_back(chunks).first()
    want = [("user", "first"), ("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == _digest(want)
    assert chat.read_back(chat.format_log(spark.createDataFrame([], TALK), kind_col=None, target_col=None, seq_cols=("turn",))).count() == 0


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_a_long_conversation_spans_tasks(spark, chunk):
    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(2000)]
    df = spark.createDataFrame([(7, i, r, t, 0, "") for i, (r, t) in enumerate(turns)], TALK).repartition(5)
    chunks = chat.format_log(df, kind_col=None, target_col=None, seq_cols=("turn",), chunk_chars=chunk)
    r = chat.read_back(chunks).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == _digest(turns)


@pytest.mark.parametrize(("tasks", "events"), [(8, 64), (3, 1), (1, 512)])
def test_a_hot_conversation_is_never_in_one_task(spark, tasks, events):
    """Every kind of event, and those that reach far back: segments are composed, no task gets more than its range."""
    import random

    rng = random.Random(tasks)
    rows = []
    for seq in range(1500):
        kind = rng.choice(["message", "start", "delta", "delta", "edit", "regenerate", "message"])
        target = rng.choice([None, None, rng.randrange(300), 10**6]) if kind in ("edit", "regenerate") and rng.random() < 0.1 else None
        rows.append((1, seq, kind, target, rng.choice(["user", "assistant"]), f"t{seq}"))
    rows += [(0, 0, "message", None, "user", "a"), (2, 0, "delta", None, None, "b"), (None, 0, "edit", 0, None, "c"), (3, 0, "regenerate", None, None, None), (3, 1, "message", None, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, target int, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        if tasks == 8:
            held = chat.segments(df, segment_events=events).where("conv_id = 1").groupBy(F.shiftright("seg", 32)).agg(F.sum(F.size("kinds")).alias("n"), F.max(F.size("kinds")).alias("most")).collect()
            assert len(held) == 8 and max(r.n for r in held) < 400 and max(r.most for r in held) <= 64
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_log(df, segment_events=events, chunk_chars=200)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == _folded(rows)
