"""Filter audit, packing and conversation trie against plain versions on small fixtures."""

import hashlib
import os
import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import permutations

import pytest

from tarnwatch.llm import audit, packing, queries, trie
from tarnwatch.session import prepare

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(queries.WORD_BPE), reason="vocabulary not available")
WHITE = " \t\n\x0b\f\r"


def words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# ---- filter audit

def plain_audit(docs, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    seen = defaultdict(list)
    for i, text, part in docs:
        text, w = text or "", words(text or "")
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        seen[part or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in seen.items():
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            alive = [True] * len(rows)
            for step, f in enumerate(order, 1):
                n = defaultdict(int)
                for k, (fails, g, t) in enumerate(rows):
                    n["unique_fails"] += fails[f] and sum(fails.values()) == 1
                    n["redundant"] += fails[f] and not alive[k]
                    if fails[f] and alive[k]:
                        n["removed"], n["good_lost"], n["toxic_lost"], alive[k] = n["removed"] + 1, n["good_lost"] + g, n["toxic_lost"] + t, False
                n["kept"] = sum(alive)
                shapley[f] += n["removed"]
                out[part, order, step] = n
        for (p, order, step), n in out.items():
            if p == part:
                n["shapley"] = shapley[order[step - 1]]
    return out


def audited(docs, labels):
    rows = audit.audit(audit.masks(docs, labels)).collect()
    return {(r.part, r.filter_order, r.step): {m: r[m] for m in (*audit.MEASURES, "shapley")} for r in rows}


def test_audit_counts_every_order(spark):
    prepare(spark)
    chance = random.Random(5)
    pool = [" ".join(chance.choice(["ein", "wort", "UND", "noch", "#eins", "ÄÖ"]) + str(chance.randrange(200)) for _ in range(chance.choice([3, 99, 100, 130]))) for _ in range(12)]
    docs = [(k, chance.choice(pool), chance.choice(["de", "en", None])) for k in range(80)]
    docs += [(200, None, "de"), (201, "", "de"), (None, pool[0], "en"), (None, None, None), (7, pool[1], "en"), (7, pool[1], "en"), (202, "A\x0bB\x1c c " * 40000, "long")]
    labels = [(k, chance.choice([0, 1, None]), chance.choice([0, 1, None])) for k in range(90)] + [(3, 1, 0), (None, 1, 1), (3, 0, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, n string")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    want = plain_audit(docs, labels)
    got = audited(frame, marks)
    assert set(got) == set(want) and len(want) == 600 * 4
    assert all(got[k] == {m: want[k][m] for m in got[k]} for k in want)
    assert audited(frame, marks.limit(0))["de", "ABCDE", 1]["good_lost"] == 0
    assert audited(frame.limit(0), marks) == {}


# ---- packing

def plain_best_fit(lengths, capacity):
    """Remaining capacities of best-fit decreasing, one piece after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        insort(rooms, room - n)
    return rooms


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    chance = random.Random(seed)
    capacity = chance.choice([1, 7, 64, 100, 4096])
    top = chance.choice([capacity, max(1, capacity // 3), max(1, capacity // 20)])
    lengths = [min(capacity, chance.choice([chance.randint(1, top), top, 1 + top // 2])) for _ in range(chance.choice([1, 40, 3000]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows, number = packing.plan(counts, capacity)
    rooms = plain_best_fit(lengths, capacity)
    assert number == len(rooms)
    held = defaultdict(list)
    for length, n in counts.items():
        own = [r for r in rows.tolist() if r[0] == length]
        for rank in range(n):
            _, start, each, first, offset = max(r for r in own if r[1] <= rank)
            held[first + (rank - start) // each].append((offset + (rank - start) % each * length, length))
    assert sorted(capacity - sum(n for _, n in v) for v in held.values()) == rooms
    for parts in held.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n


def test_open_sequences_find_the_tightest():
    chance, opened, rooms = random.Random(1), packing.OpenSequences(50), []
    for k in range(600):
        if chance.random() < 0.5 or not rooms:
            rooms.append(chance.randint(1, 50))
            opened.push(rooms[-1], k, 1)
        want = chance.randint(1, 50)
        fits = [r for r in rooms if r >= want]
        assert opened.tightest(want) == (min(fits) if fits else None)
        if fits:
            rooms.remove(min(fits))
            opened.pop(min(fits))


ODD_TEXTS = [None, "", " ", "Don't  STOP\x1cme, it's 2024!", "É é é ﬁ İstanbul ΟΔΟΣ ǅ Ǆ", "a<|endoftext|>b <|STARTOFTEXT|>", "漢字 кириллица 🙂👍🏽", "x" * 5000, "’tis \xa0   　 \x85 end",
             "word, " * 9000, "''' 's'S 'RE'll", "½ ² ①", "ß ẞ ŉ"]


@needs_vocabulary
def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    prepare(spark)
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    texts = [*ODD_TEXTS, *["the same words again " * (k % 40) for k in range(150)]]
    docs = spark.createDataFrame([(None if k % 50 == 3 else k // 2, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(docs, queries.WORD_BPE, keep=("doc_id", "offset", "text"), capacity=64, with_ids=True).cache()
    rows = got.collect()
    wanted = []
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 64):
            part = ids[at:at + 64]
            wanted.append((None if k % 50 == 3 else k // 2, t, at // 64, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), part))
    mine = [(r.doc_id, r.text, r._pk_piece, r._pk_start, r._pk_length, r._pk_crc32, r._pk_ids) for r in rows]
    assert sorted(mine, key=str) == sorted(wanted, key=str) and {r.offset for r in rows} == {"clash"}
    held = defaultdict(list)
    for r in rows:
        held[r._pk_sequence].append((r._pk_offset, r._pk_length, r._pk_ids))
    assert sorted(64 - sum(n for _, n, _ in v) for v in held.values()) == plain_best_fit([w[4] for w in wanted], 64)
    whole = {r._pk_sequence: r for r in packing.sequences(got).collect()}
    for k, parts in held.items():
        parts.sort()
        assert [o for o, *_ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))]
        assert whole[k]._pk_ids == [i for *_, ids in parts for i in ids] and whole[k]._pk_tokens == len(whole[k]._pk_ids)
    got.unpersist()
    assert packing.pack(docs.limit(0), queries.WORD_BPE).count() == 0


@needs_vocabulary
@needs_data
def test_words_encode_as_whole_texts(spark):
    from tokenizers import Tokenizer

    tokenizer, mine = Tokenizer.from_file(queries.WORD_BPE), packing.encoder(queries.WORD_BPE)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(20).collect()]
    texts += [t for t in ODD_TEXTS if t] + ["".join(map(chr, range(lo, lo + 64))) for lo in range(0, 0x2100, 64)]
    want = [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert mine.splits_letters and list(map(mine.encode, texts)) == want


# ---- conversation trie

def plain_trie(rows, family=20, heads=4):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = turns.get(c - c % family, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = {}
    for node, m in members.items():
        below = [u for u in members if u[:len(node)] == node]
        children = [u for u in below if len(u) == len(node) + 1]
        leaves = [u for u in below if not any(v[:len(u)] == u and len(v) == len(u) + 1 for v in below)]
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node))))
        out[min(m), len(node)] = (min(members[node[:-1]]) if node else None, len(m), len(children), len(leaves),
                                  sum((len(members[u]) - 1) * len(words(u[-1][1])) for u in below if u), hashlib.sha256(ends.encode()).hexdigest())
    return out


def tried(conversations, **options):
    rows = trie.nodes(conversations, **options).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


CONV = "conv_id long, turn long, role string, text string, depth string"


def test_trie_of_odd_conversations(spark):
    prepare(spark)
    chance = random.Random(3)
    rows = [(c, t, chance.choice(["user", "assistant", None]) if t > 1 else "system", chance.choice(["hi there", "again and again", "", None]) if t < 4 else f"only {c}")
            for c in range(90) if c % 11 for t in range(c % 8)]
    rows += [(300 + k, t, "user", f"same words at {t}") for k in range(40) for t in range(5)]
    rows += [(1000, t // 3 if t % 7 else None, "user", f"x{t % 5}") for t in range(400)] + [(1001, 0, "user", "short")]
    rows += [(2000, 0, "u", "a"), (2000, 0, "u", "a"), (None, 0, "user", "lost"), (-3, 0, "user", "below"), (-3, 1, "user", "zero"), (-43, 0, "user", "below")]
    chance.shuffle(rows)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], CONV).repartition(4)
    want = plain_trie(rows)
    assert tried(frame) == want
    assert tried(frame.limit(0)) == {}
    only = spark.createDataFrame([(1, 0, "user", "one", "")], CONV)
    assert tried(only) == plain_trie([(1, 0, "user", "one")])


@needs_data
def test_full_sketches_change_nothing(spark):
    talks = prepare(spark).read.parquet("/root/testdata/sf0.1/conversations.parquet")
    roomy, tight = tried(talks), tried(talks, max_cells=trie.BLOCK)
    assert roomy == tight and sum(v[1] == 1 for v in roomy.values()) > len(roomy) // 2


@needs_data
def test_screening_proves_singletons_only(spark):
    talks = prepare(spark).read.parquet(f"{SF}/conversations.parquet")
    turns, _ = trie.rebuilt(trie.ordered_turns(talks), 20, 4)
    seen = trie.screened(trie.prefixes(turns).cache()).collect()
    times = defaultdict(int)
    for r in seen:
        times[r.a, r.b] += 1
    assert all(times[r.a, r.b] == 1 for r in seen if r.alone) and all(r.alone for r in seen if r.tail)
    assert sum(r.alone for r in seen) > 0.9 * sum(n == 1 for n in times.values()) > 0


def test_ends_of_a_hot_node_are_hashed_in_order(spark):
    ids = list(range(-300, 900))
    ends = prepare(spark).createDataFrame([(1, 5, 6, c) for c in ids] + [(0, 0, 0, 7)], "depth long, a long, b long, conv_id long").repartition(5)
    got = {r.depth: r.ends_sha256 for r in trie.end_digests(ends).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 0: hashlib.sha256(b"7").hexdigest()}
