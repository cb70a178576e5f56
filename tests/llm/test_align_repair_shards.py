"""Cross-tokenizer alignment, conversation repair and sharding against brute force."""

import hashlib
import itertools
import json
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpus_fixtures import SMALL, docs  # noqa: F401
from ledgerlake.llm import conversation_repair as repair
from ledgerlake.llm import cross_align, queries, sharding
from ledgerlake.llm.bpe import byte_alphabet
from ledgerlake.testing import compare, duck_connection

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# ---------------------------------------------------------------- cross-tokenizer alignment


def plain_alignment(rows):
    """op11's result in plain Python with the tokenizers and sentencepiece libraries."""
    a_model = Tokenizer.from_file(BYTE_LEVEL)
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=PIECES)
    alphabet = byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in json.load(open(BYTE_LEVEL))["model"]["vocab"].items()
               if all(c in alphabet for c in t)}
    found = []
    for doc, text in rows:
        text = text or ""
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        want = (" " + text).encode()
        if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes) != want:
            found.append((doc, [], [], []))
            continue
        ends_a = list(itertools.accumulate(len(a_bytes[i]) for i in a))
        ends_b = list(itertools.accumulate(map(len, b_bytes)))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        found.append((doc, a, b, groups))
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for _, _, _, g in found]
    counts = Counter(p for own in links for p in set(own))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (doc, a, b, groups), own in zip(found, links):
        written = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((doc, len(a), len(b), len(groups), len(own), sum(counts[p] == top[p[0]] for p in own),
                    sum(counts[p] for p in own), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def op11_rows(df, **settings):
    out, col = cross_align.align(df, BYTE_LEVEL, PIECES)
    f = F.col(col).getField
    scored = cross_align.score(out, col, {
        "doc_id": F.col("doc_id"), **{c: f(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
        "sha": F.when(f("n_a") > 0, F.sha2(f("groups"), 256)).otherwise("")}, **settings)
    return sorted(map(tuple, scored.rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", scored.n_best,
                                                scored.count_sum, "sha").collect()), key=str)


ODD_TEXTS = [None, "", " ", "  two  blanks ", "a\nb\tc", "<s> [INST] </s><|endoftext|>", "▁under", "ﬁligature",
             "日本語の文", "\U0001f600\U0001f601 emoji", "x" * 3000, "ab" * 1500 + "é", "\x00nul", "trail ",
             "ภาษาไทย " * 40, "don't (stop)!", "a", "7" * 500]


@pytest.mark.parametrize("hot_pairs", [1_000_000, 40, 0])
def test_alignment_matches_plain_python(docs, hot_pairs):
    """Odd texts, repeated rows and random ones; statistics broadcast, joined, or both."""
    rng = random.Random(11)
    parts = ["the", " and", "tion", "ing ", "été", ", ", "\n", "1998", "<0x41>", "Qx", " привет", "."]
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(1000, "the same text"), (1000, "the same text"), (None, "the end")]
    rows += [(100 + i, "".join(rng.choices(parts, k=rng.randint(1, 40)))) for i in range(40)]
    assert op11_rows(docs(rows), hot_pairs=hot_pairs) == plain_alignment(rows)


def test_op11_query_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op11_cross_tokenizer"](spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(rows)


def test_op11_empty_table_and_clashing_columns(spark, docs):
    assert op11_rows(docs([]).limit(0)) == []
    df = docs([(1, "a b")]).withColumn("aligned", F.lit(7)).withColumn("n_best", F.lit(8))
    out, col = cross_align.align(df, BYTE_LEVEL, PIECES)
    assert col != "aligned" and out.first()["aligned"] == 7
    scored = cross_align.score(out, col, {c: F.col(c) for c in ("doc_id", "aligned", "n_best")})
    row = scored.rows.first()
    assert (row["aligned"], row["n_best"]) == (7, 8) and scored.n_best != "n_best"


def test_probing_finds_every_common_end():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 80)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), k=max(1, int(n * share)))})
                for share in (rng.choice([rng.random(), 1, .95]), rng.choice([rng.random(), 1, .95])))
        to_a, to_b = (cross_align._places(len(e), inner).tolist()
                      for e, inner in zip((a, b), cross_align.alignment(a, b)))
        assert [a[i - 1] for i in to_a] == [b[j - 1] for j in to_b] == sorted(set(a) & set(b))


def test_special_order_of_the_vocabulary_is_checked():
    spec = json.load(open(BYTE_LEVEL))
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        cross_align.ByteLevel(json.dumps(spec))


# ---------------------------------------------------------------- conversation repair

STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_cheapest(rows, source, targets):
    """(cost, audit) by relaxing all places from the left until nothing changes."""
    reached = {source: (0, "")}

    def with_inserts(states):
        again = True
        while again:
            again = False
            for q, (cost, audit) in list(states.items()):
                for role, to in STEPS[q].items():
                    found = (cost + 3, audit + "I")
                    if role in "ua" and found < states.get(to, (10 ** 9, "")):
                        states[to] = found
                        again = True
        return states
    reached = with_inserts(reached)
    for initial, flag in rows:
        ahead = {}
        for q, (cost, audit) in reached.items():
            options = [(q, 4, "D")]
            if flag not in "12":
                extra = 3 if flag == "3" else 0
                options += [(to, extra, "K") for r, to in STEPS[q].items() if r == initial]
                options += [(to, 3 + extra, "R") for r, to in STEPS[q].items() if r in "ua"]
            for to, step, letter in options:
                found = (cost + step, audit + letter)
                if found < ahead.get(to, (10 ** 9, "")):
                    ahead[to] = found
        reached = with_inserts(ahead)
    return min((reached[t] for t in targets if t in reached), default=None)


def test_bidirectional_search_matches_relaxation():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suuaa-"), rng.choice("000123")) for _ in range(rng.randint(0, 12))]
        text = "".join(a + b for a, b in rows)
        for source in repair.STATES:
            for targets in (repair.ENDS, *[frozenset((t,)) for t in repair.STATES]):
                assert repair.cheapest(text, source, targets) == plain_cheapest(rows, source, targets), (rows, source, targets)


@pytest.mark.parametrize("block", [1, 3, 7, 256])
def test_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(2)
    for _ in range(120):
        rows = [(rng.choice("suuuaaa-"), rng.choice("0000123")) for _ in range(rng.randint(1, 40))]
        search = repair.Search()
        for r in rows:
            search.add(*r)
        assert search.result() == plain_cheapest(rows, 0, (0, 3))


def plain_report(rows):
    """op12's result for (conv, turn, role, text) rows, in plain Python."""
    damaged = {}
    for conv, turn, role, text in rows:
        own = damaged.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in damaged.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        flags, seen = "", set()
        for _, role, text in own:
            rest = text.rstrip(" \t\n\x0b\x0c\r")
            flags += "1" if not rest else "2" if (role, text) in seen else "3" if rest[-1] not in ".!?" else "0"
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = plain_cheapest([(r[1][:1] or "-", f) for r, f in zip(own, flags)], 0, (0, 3)) if own else (0, "")
        lines, at, state = [], 0, 0
        for letter in audit:
            role, text = (own[at][1], own[at][2]) if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = STEPS[state][role[0]]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, flags.count("1"), flags.count("2"), flags.count("3"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


ORDER = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "k") for c, t, r, x in rows],
                                 "conv_id long, turn long, role string, text string, cost string")


def test_report_matches_plain_python(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", "", " \t", None, "What? ", "End!\n", "a.b", "...", "é。"]
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rng.randint(1, 9)):
            at = None if rng.random() < .05 else turn * rng.choice([1, 1, 1, 2])
            rows.append((conv, at, rng.choice(["user", "assistant", "system", "tool", "", None, "Use"]), rng.choice(texts)))
    rows += [(700, t, "user" if t % 2 == 0 else "assistant", "Fine.") for t in range(700)]     # a long one
    df = conversations(spark, rows)
    got = repair.report(df, repair.damage(df)).select(*ORDER).collect()
    assert sorted(map(tuple, got), key=str) == plain_report(rows)


def test_report_without_rows_and_all_dropped(spark):
    none = conversations(spark, []).limit(0)
    assert repair.report(none, repair.damage(none)).collect() == []
    dropped = [(c, t) for c in range(80) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    df = conversations(spark, [(c, t, "user", "Hi.") for c, t in dropped])
    want = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in sorted({c for c, _ in dropped})]
    assert sorted(map(tuple, repair.report(df, repair.damage(df)).select(*ORDER).collect())) == want


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = repair.marked(repair.damage(df)).cache()
    turns = {}
    for r in repair.repaired(rows, repair.plans(rows)).orderBy("conv_id", "seq").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"][0], r["text"]))
    for own in turns.values():
        roles = "".join(r for r, _ in own).removeprefix("s")
        assert roles and roles == "ua" * (len(roles) // 2)


def test_op12_query_matches_its_oracle(spark):
    for folder in (SMALL, SMALL.replace("0.001", "0.01")):
        rows, problems = compare(queries.QUERIES["op12_conversation_repair"](spark, folder), duck_connection(folder),
                                 queries.ORACLES["op12_conversation_repair"])
        assert rows and not problems, problems


# ---------------------------------------------------------------- sharding


def placed(out):
    return [(r[out.shard], r[out.slot], r["doc_id"], r["text"]) for r in out.rows.collect()]


def check_law(rows, n, shards):
    sizes = Counter(s for s, *_ in rows)
    assert len(rows) == n and set(sizes) <= set(range(shards))
    full = [sizes.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1
    for s in sizes:
        assert sorted(slot for shard, slot, *_ in rows if shard == s) == list(range(sizes[s]))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000])
def test_shards_differ_by_at_most_one_and_keep_every_row(docs, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, i, 3]), rng.choice([None, "", f"text {i}", "same"])) for i in range(n)]
    df = docs(rows) if rows else docs([]).limit(0)
    got = placed(sharding.shuffled(df, 16))
    check_law(got, n, 16)
    assert Counter((d, t) for *_, d, t in got) == Counter(rows)


def test_hot_copies_are_scattered(spark, docs):
    """Two thirds of the rows are one row; no shard and no task sees more of them than chance gives."""
    rows = [(7, "copy")] * 4000 + [(i, f"t{i}") for i in range(2000)]
    got = placed(sharding.shuffled(docs(rows), 16))
    check_law(got, 6000, 16)
    assert Counter((d, t) for *_, d, t in got) == Counter(rows)
    per = Counter(s for s, _, d, t in got if t == "copy")
    assert len(per) == 16 and max(per.values()) < 4000 / 16 * 1.4
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = sharding.shuffled(docs(rows), 16).rows.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(Counter(r["p"] for r in tasks).values()) < 6000 / 4


def test_the_shuffle_depends_on_records_and_seed_alone(docs):
    rows = [(i, f"text {i}") for i in range(600)] + [(9, "x")] * 300
    one, two = (sorted(placed(sharding.shuffled(docs(rows).repartition(p), 4))) for p in (1, 6))
    assert one == two
    other = sorted(placed(sharding.shuffled(docs(rows), 4, seed=5)))
    assert sum(a != b for a, b in zip(one, other)) > 700


def test_the_order_looks_random(docs):
    """Shard and slot say nothing about the id: neighbours, halves and shards are mixed as chance has it."""
    n = 8000
    got = sorted(placed(sharding.shuffled(docs([(i, f"t{i}") for i in range(n)]), 8)))
    ids = [d for *_, d, _ in got]
    mean = (n - 1) / 2
    rank = sum((i - mean) * (d - mean) for i, d in enumerate(ids)) / sum((i - mean) ** 2 for i in range(n))
    assert abs(rank) < 0.05
    assert sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:])) < 20
    assert all(abs(sum(d < n / 2 for s, _, d, _ in got if s == k) - n / 16) < 110 for k in range(8))


def test_written_shards_and_clashing_columns(spark, docs, tmp_path):
    df = docs([(i, "t" * (i % 50)) for i in range(500)]).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(1.5))
    out = sharding.write_shards(df, str(tmp_path / "out"), 16)
    assert out.shard not in df.columns and out.rows.columns == [*df.columns, out.slot, out.shard]
    check_law([(r[out.shard], r[out.slot]) for r in out.rows.collect()], 500, 16)
    assert {r["shard"] for r in out.rows.collect()} == {"mine"}
    # files hold their rows in slot order
    by_file = out.rows.withColumn("f", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).collect()
    for f in {r["f"] for r in by_file}:
        slots = [r[out.slot] for r in sorted((r for r in by_file if r["f"] == f), key=lambda r: r["at"])]
        assert slots == sorted(slots)
    empty = sharding.write_shards(docs([]).limit(0), str(tmp_path / "none"), 16)
    assert empty.rows.count() == 0


def test_small_buckets(docs):
    rows = [(i, "t" * (i % 70)) for i in range(3000)]
    got = placed(sharding.shuffled(docs(rows), 5, bucket_bytes=2000, bucket_rows=40))
    check_law(got, 3000, 5)
    assert Counter((d, t) for *_, d, t in got) == Counter(rows)


def test_sharding_runs_without_python(docs):
    plan = sharding.shuffled(docs([(1, "a")]), 4).rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op13_query(spark):
    got = queries.QUERIES["op13_shards"](spark, SMALL)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    table = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = got.collect()
    check_law([(r["shard"], r["slot"]) for r in rows], len(table), 16)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in table)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
