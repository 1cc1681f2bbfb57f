"""Periodic runs, conversation repair and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weekloom.llm import packing, queries, repair, runs

DOCS = "doc_id bigint, text string"
TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    queries.reachable(spark)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs -------------------------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                s = w[i : j + q]
                if all(any(s[k] != s[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def random_words(rng, most):
    w, letters = [], rng.choice([1, 2, 3, 5, 30])
    while len(w) < most:
        if rng.random() < 0.4:
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, max(2, most // 5)))]
            w += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
        else:
            w += [rng.randrange(letters) for _ in range(rng.randint(1, max(1, most // 8)))]
    return w[: rng.randint(0, most)]


@pytest.mark.parametrize("most,times", [(40, 1500), (300, 120), (900, 12)])
def test_runs_by_brute_force(most, times):
    rng = random.Random(most)
    for _ in range(times):
        w = random_words(rng, most)
        assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_runs_of_bad_texts_take_no_square_time():
    fib = ["a", "ab"]
    while len(fib[-1]) < 60_000:
        fib.append(fib[-1] + fib[-2])
    for w in ([0] * 300_000, [0, 1, 2] * 100_000, sum(([0] * 500 + [i] for i in range(1, 400)), []), [ord(c) for c in fib[-1]]):
        runs.find_runs(np.array(w, np.int64))
    assert runs.find_runs(np.arange(5000).repeat(1) % 1000) == [(0, 5000, 1000)]


def test_runs_want_four_periods(spark):
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], DOCS), power=3)


def brute_op11(doc, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc, len(found), start, length, period, best and 1000 * length // period, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_by_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    odd = [(None, "a a a a a a a"), (-1, None), (-2, ""), (-3, " \n\t "), (-4, "x x x x x x x x x x x x"), (-5, "a b " * 50), (-5, "a b " * 50), (30, "é è é è\x0bé è\x0cé è é"), (-6, "b a a a a a a b a a a a a a b")]
    many = [(10_000 + i, " ".join(random.Random(i).choice("abcdefgh") for _ in range(i % 90))) for i in range(400)]
    rows = [(r.doc_id, r.text) for r in docs] + odd + many
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOCS + ", runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(brute_op11(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 40


def test_runs_give_their_texts(spark):
    rows = spark.createDataFrame([(1, "go go go go go go now"), (2, None)], DOCS)
    assert [tuple(r) for r in runs.periodic_runs(rows).orderBy("doc_id").collect()] == [(1, [(0, 6, 1)], "go now"), (2, [], "")]
    assert runs.periodic_runs(rows.limit(0)).count() == 0


# ---- conversation repair -------------------------------------------------------------------------------------------

ORDER = {"K": 0, "R": 1, "D": 2}


def brute_audit(kinds):
    """(cost, audit) by trying all edits; kinds: (initial or d, truncated)."""
    best, grammar = None, re.compile("(s?(ua)+)?")
    for inserts in product(("", "u", "a", "ua", "au"), repeat=len(kinds) + 1):
        if sum(map(len, inserts)) > 3:
            continue
        for edits in product("KrRD", repeat=len(kinds)):  # r: to user, R: to assistant
            roles, cost, audit = inserts[0], 5 * len(inserts[0]), "I" * len(inserts[0])
            for (kind, truncated), edit, after in zip(kinds, edits, inserts[1:]):
                if edit != "D" and kind == "d":
                    break
                roles += {"K": kind, "r": "u", "R": "a", "D": ""}[edit] + after
                cost += ORDER[edit.upper()] + 5 * (truncated and edit != "D") + 5 * len(after)
                audit += edit.upper() + "I" * len(after)
            else:
                if grammar.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def dynamic_audit(kinds):
    best = {"": (0, "")}  # by the last role, of whatever is before
    adds = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(2):
            for (a, r), to in adds.items():
                if a in best and r != "s":
                    new = (best[a][0] + 5, best[a][1] + "I")
                    best[to] = min(best.get(to, new), new)
        return best

    for kind, truncated in kinds:
        new = {}
        for a, (cost, audit) in inserted(best).items():
            ways = [(a, cost + 2, audit + "D")]
            if kind != "d":
                ways += [(adds[a, r], cost + (r != kind) + 5 * truncated, audit + ("K" if r == kind else "R")) for r in "sua" if (a, r) in adds and (r == kind or r != "s")]
                ways += [(adds[a, r], cost + 1 + 5 * truncated, audit + "R") for r in "ua" if (a, r) in adds]
            for to, *way in ways:
                new[to] = min(new.get(to, tuple(way)), tuple(way))
        best = new
    best = inserted(best)
    return min(v for k, v in best.items() if k in ("", "a"))


def test_the_plain_program_by_trying_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            kinds = [(k := rng.choice("suaod"), k != "d" and rng.random() < 0.4) for _ in range(n)]
            assert dynamic_audit(kinds) == brute_audit(kinds), kinds


def brute_op12(turns):
    """By conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    by_conv, out = {}, {}
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in turns:
        rows = by_conv.setdefault(conv, [])
        role, text = space(role), space(text)
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, counts = set(), [], Counter()
        for _, role, text in rows:
            stripped = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds.append(("d" if fault in ("blank", "duplicate") else initial, fault == "truncated"))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = dynamic_audit(kinds)
        state, lines, rest = "", [], iter(rows)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(rest)
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == "u" else "user"
                state = role[0]
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


def random_turns(rng, conv, n):
    texts = ["yes.", "no!", "", " \n", "so", "what?", "what? ", "um", None]
    return [(conv, rng.choice([i, i, i, i + 1, None]) if rng.random() < 0.2 else i, rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[i % 2], rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}.") for i in range(n)]


@pytest.mark.parametrize("block", [512, 7])
def test_op12_by_brute_force(spark, sf_dir, tmp_path, monkeypatch, block):
    """With blocks of seven turns nearly all conversations are of several blocks."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(11)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [t for c in range(1000, 1120) for t in random_turns(rng, c, rng.randint(1, 40))]
    rows += random_turns(rng, None, 25) + random_turns(rng, -1, 600)
    rows += [(-2, i, "user", "same.") for i in range(30)] + [(-3, None, "assistant", None)] * 3
    gone = next(c for c in range(5000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "alone."))
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", audit string")
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute_op12(rows)
    found = repair.op12_structure_repair(spark, str(tmp_path)).collect()
    assert len(found) == len(want)
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_op12_repairs_a_conversation_once(spark, sf_dir):
    plan = queries.QUERIES["op12_structure_repair"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow run(") == 1


def test_repair_of_nothing(spark):
    assert repair.repair(spark.createDataFrame([], TURNS)).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


def best_fit(lengths, capacity):
    """Number of sequences by best fit, longest first, piece by piece."""
    rooms = Counter()
    made = 0
    for n in sorted(lengths, reverse=True):
        r = min((r for r in rooms if r >= n and rooms[r]), default=None)
        if r is None:
            made, r = made + 1, capacity
        else:
            rooms[r] -= 1
        rooms[r - n] += 1
    return made


def slots_of(counts, capacity):
    by_sequence = {}
    for length, lo, hi, each, first, offset in packing.plan(counts, capacity):
        for k in range(hi - lo):
            by_sequence.setdefault(first + k // each, []).append((offset + k % each * length, length))
    return by_sequence


def check_gapless(by_sequence, capacity):
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([1, 5, 17, 64])
        counts = {n: rng.choice([1, 2, 7, 40]) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
        by_sequence = slots_of(counts, capacity)
        check_gapless(by_sequence, capacity)
        assert Counter(n for p in by_sequence.values() for _, n in p) == Counter(counts)
        assert len(by_sequence) == best_fit(Counter(counts).elements(), capacity)


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 1000) for n in range(1, 2049)}
    few, many = packing.plan(counts, 2048), packing.plan({n: c * 10**9 for n, c in counts.items()}, 2048)
    assert len(many) < 20_000 and len(few) < 20_000
    with pytest.raises(ValueError):
        packing.plan({2049: 1}, 2048)


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)] and packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]


def test_encoder_is_the_librarys(spark, sf_dir):
    library, own, rng = Tokenizer.from_file(packing.VOCABULARY), packing.Encoder(), random.Random(7)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "  ", "a   b\n\n c \n d\t e", "x　y  z", "it's <|endoftext|> we'll<|endoftext|>  no", "\n \n b", "ab\r\n  c", "\x1c a\x1d b", " Ġ Ġa"]
    texts += ["".join(rng.choice(" \n\tab'st.1éĠ 　 \x85") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "MOST_PARTS", 5)
    own = packing.Encoder()
    text = "one two three four five six seven " + "x" * 60 + " end."
    assert [own.encode(text) for _ in range(3)] == own._library([text]) * 3


def test_op13_by_brute_force(spark, sf_dir, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(-1, None), (None, "some words"), (None, None), (-2, "twice"), (-2, "twice"), (-3, "word " * 9000), (-4, " a" * 2047), (-5, " a" * 2048), (-6, " a" * 2046)] + [(50_000 + i, "same length") for i in range(700)]
    spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", sequence_id int, _n int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(packing.VOCABULARY)
    want = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        for k, (a, b) in enumerate([(0, first), *((a, a + 2048) for a in range(first, len(ids), 2048))]):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = packing.op13_best_fit_packing(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    check_gapless(by_sequence, 2048)
    assert len(by_sequence) == best_fit([r.length for r in found], 2048)


def test_pack_any_table(spark):
    rows = spark.createDataFrame([(i, 1 + i % 3, "x") for i in range(50)], "key int, size int, _part string")
    by_sequence = {}
    for r in packing.pack(rows.drop("_part"), "size", 7).collect():
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.size))
    check_gapless(by_sequence, 7)
    assert packing.pack(rows.drop("_part").limit(0), "size", 7).count() == 0
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(rows.drop("_part").withColumn("size", F.lit(8)), "size", 7).count()
