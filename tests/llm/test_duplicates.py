"""Near-duplicates, substring and line deduplication, decontamination, and the pipeline, against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tidewright.llm import _text, decontam, line_dedup, minhash, repetition, suffix_dedup
from tidewright.llm._graph import connected_components, shared_buckets
from tidewright.llm._spark import probably_in

import corpus_pipeline
from conftest import SF, TINY


def table(sf, name):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").df()


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    return sets, components(ids, links)


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 900)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(want[n] == r for n, r in got.items())
    assert all(n in got for n in want if want[n] != n)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_shared_buckets(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.randrange(40), rng.randrange(60)) for _ in range(120)] + [(77, i % 9) for i in range(50)] + [(78, 5)] * 9 + [(79, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(r) for r in shared_buckets(spark.createDataFrame(rows, "bucket long, node long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(set)
    for b, n in rows:
        groups[b].add(n)
    assert got == sorted((b, n, min(g)) for b, g in groups.items() if len(g) > 1 for n in g)


def test_simhash_blocks_by_hand():
    rng = np.random.Generator(np.random.PCG64(6))
    gram, of = rng.integers(0, 2**63, 4000, dtype=np.uint64), np.sort(rng.integers(0, 9, 4000))
    width, blocks = np.array([40, 10, 33, 0, 200, 32, 90, 5, 60]), np.array([18, 32, 18, 18, 40, 18, 18, 32, 18])
    votes = defaultdict(set)
    for deal in range(8):
        seed = np.uint64(0xA0761D6478BD642F * deal & (2**64 - 1))
        own = [int(x) for x in (_text.mix(gram + seed) if deal else gram)]
        for h, span in zip(own, of, strict=True):
            w = int(width[span])
            number = ((h >> 40) * w >> 24) + deal * w
            if w and number < blocks[span]:
                votes[int(span), number].add(h & 0xFFFFFFFF)
    want = {k: sum(1 << bit for bit in range(32) if 2 * sum(x >> bit & 1 for x in v) > len(v)) for k, v in votes.items() if len(v) >= line_dedup.LEAST}
    got = line_dedup.simhash_blocks(gram, of, width, blocks)
    assert {(int(s), int(n)): int(v) for s, n, v in zip(*got, strict=True)} == want


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    got = {r["id"] for r in probably_in(spark.range(20_000), "id", keys).collect()}
    assert set(range(0, 3000, 7)) <= got
    assert len(got) < 1500


def test_near_duplicates_of_groups(docs_of):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):  # copies with more and more edits: many pairs lie about the threshold
        own = list(base)
        for _ in range(i // 20):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, rows[i][1].upper()) for i in range(0, 60, 3)]
    rows += [(300, "a b"), (301, "A  b"), (302, "b a"), (303, ""), (304, None)]
    sets, want = near(rows)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(rows)).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert all(r["kept"] == (d == want[d]) for d, r in got.items())
    assert len({want[i] for i in range(150)}) > 1


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 13
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)] * 2
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (5, 6, 2**62, -4)} == {(5, 5), (6, 5), (2**62, -4), (-4, -4)}
    assert minhash.near_duplicates(no_docs).count() == 0


def test_rows_that_share_a_doc_id(docs_of):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = docs_of([(1, a), (1, b), (2, b + " z"), (3, a + " y"), (1, a), (None, a), (9, None), (10, "")])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter({(1, 56, 1, True): 3, (2, 57, 1, False): 1, (3, 57, 1, False): 1, (None, 56, None, True): 1, (9, 0, 9, True): 1, (10, 0, 10, True): 1})
    kept = Counter((r["doc_id"], r["text"]) for r in minhash.one_of_each(docs).collect())
    assert kept == Counter([(1, a), (1, b), (None, a), (9, None), (10, "")])


@pytest.mark.parametrize("seed", range(3))
def test_no_group_is_lost_or_kept_twice(docs_of, seed):
    """Random groups of edited texts under doc_ids that repeat: one row of each group stays, by brute force."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(8)]
    rows = []
    for _ in range(60):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            own[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(25), " ".join(own)))
    _, root = near(list(enumerate(t for _, t in rows)))
    groups = defaultdict(set)
    for i, r in root.items():
        groups[r].add(rows[i])
    kept = [(r["doc_id"], r["text"]) for r in minhash.one_of_each(docs_of(rows)).collect()]
    assert len(kept) == len(groups)
    for members in groups.values():
        own = [k for k in kept if k in members]
        assert len(own) == 1
        assert own[0][0] == min(d for d, _ in members)


def thue_morse(n, x="a", y="b"):
    return "".join((x, y)[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_crafted_texts_are_told_apart(docs_of, n):
    """Thue-Morse words and their complements have equal polynomial fingerprints modulo 2**64 at any base."""
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    measured = repetition.measure(*_text.texts(pa.array([f"{x}\n{y}"])), 8)
    assert measured["n_dup_lines"][0] == 0
    lines = line_dedup.fuzzy_line_dedup(docs_of([(1, f"{x}\n{y}")])).collect()
    assert lines[0]["removed"] == []
    words = [" ".join(w) for w in (thue_morse(n, *pair) for pair in (("p", "q"), ("q", "p")))]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of([(1, x), (2, y), (3, words[0]), (4, words[1])])).collect()}
    assert got[1]["component_id"] != got[2]["component_id"]
    assert (got[3]["component_id"] == got[4]["component_id"]) == (near([(3, words[0]), (4, words[1])])[1][4] == 3)
    rows = [(1, x), (2, y)]
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_substrings(docs_of(rows)).collect()}
    assert [removed[1], removed[2]] == [w[1] for w in covered_bytes(rows, 200)]


def test_odd_sketches_estimate_and_bound():
    rng = np.random.Generator(np.random.PCG64(3))
    common = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for same in (540, 480, 300):
        a = np.sort(np.r_[common[:same], rng.integers(0, 2**63, 600 - same, dtype=np.uint64)])
        b = np.sort(np.r_[common[:same], rng.integers(0, 2**63, 600 - same, dtype=np.uint64)])
        row = np.repeat([0, 1], [len(a), len(b)])
        maps = minhash.parity_bitmaps(np.r_[a, b], row, 2)
        odd = int(np.unpackbits((maps[0] ^ maps[1]).view(np.uint8)).sum())
        apart = len(set(a) ^ set(b))
        assert odd <= apart
        assert (apart - odd) % 2 == 0
        sketch = minhash.odd_sketches(minhash.min_hashes(np.r_[a, b], np.array([0, len(a), len(a) + len(b)])))
        flips = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
        jaccard = same / (1200 - same)
        assert (flips <= minhash.odd_limit()) == (jaccard > 0.6)


def covered_bytes(rows, depth):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + depth] for b in data for i in range(len(b) - depth + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i] += 1
                gone[i + depth] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_difference_cover_is_perfect():
    c = Counter((int(a) - int(b)) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER)
    assert sorted(c) == list(range(suffix_dedup.PERIOD))
    assert all(n == 1 for d, n in c.items() if d)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_substrings_by_hand(docs_of, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 6000)
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    parts = [noise(n) for n in (150, 199, 200, 201, 260, 500, 900)]
    rows = [(i, noise(rng.randrange(300)) + "".join(rng.choice(parts) + noise(rng.randrange(40)) for _ in range(rng.randrange(4)))) for i in range(60)]
    rows += [(100, "a" * 450), (101, "a" * 199), (102, None), (103, ""), (104, rows[3][1]), (105, parts[-1][:450] + "Z" + parts[-1][450:])]
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_substrings(docs_of(rows)).collect()}
    for (d, text), want in zip(rows, covered_bytes(rows, 200), strict=True):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_repeated_substrings_of_odd_rows(odd_docs, no_docs):
    rows = suffix_dedup.repeated_substrings(odd_docs).collect()
    assert len(rows) == 13
    assert {r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] == 7} == {True}
    assert suffix_dedup.repeated_substrings(no_docs).count() == 0
    with pytest.raises(ValueError, match="depth"):
        suffix_dedup.repeated_substrings(no_docs, depth=50)


def test_packed_keys_round_trip():
    rng = np.random.Generator(np.random.PCG64(2))
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (suffix_dedup.unpack_sorted(suffix_dedup.pack_sorted(keys)) == keys).all()


def norm(line):
    return " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[0-9]", "0", line))))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("group", [3, 2000])
def test_fuzzy_lines_by_hand(docs_of, monkeypatch, group):
    monkeypatch.setattr(line_dedup, "GROUP", group)
    rng = random.Random(11)
    vocabulary = [f"word{i}x" for i in range(400)]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            words = rng.choice(bases).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(40)] = rng.choice(vocabulary)
            lines.append(rng.choice(["{}", "{}!", "  {} 7", "{} 8"]).format(" ".join(words)))
        rows.append((d, "\n".join([*lines, rng.choice(["", "same short", "---"])])))
    forms = {norm(x) for _, t in rows for x in t.split("\n")} - {""}
    order = sorted(forms)
    links = [(a, b) for i, a in enumerate(order) for b in order[:i] if edit(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9]
    assert links
    root = components(order, links)
    seen, want = set(), {}
    for d, t in sorted(rows):
        want[d] = []
        for n, x in enumerate(t.split("\n") if t else []):
            if f := norm(x):
                if root[f] in seen:
                    want[d].append(n)
                seen.add(root[f])
    got = {r["doc_id"]: r for r in line_dedup.fuzzy_line_dedup(docs_of(rows)).collect()}
    assert {d: r["removed"] for d, r in got.items()} == want
    assert all(got[d]["n_lines"] == (len(t.split("\n")) if t else 0) for d, t in rows)


def test_fuzzy_lines_meet_by_edits_alone(docs_of):
    """Recall against edit similarity alone, of lines of any number of words: no hash takes part in what is expected."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 11)))
    rows, kinds = [], []
    for n, most in [(1, 1), (2, 1), (3, 2), (4, 2), (10, 3), (20, 5), (40, 8)]:
        for edits in range(1, most + 1):
            for _ in range(60 // most):
                while True:
                    line = " ".join(word() for _ in range(n))
                    other = list(line)
                    for at in rng.sample(range(len(line)), min(edits, len(line))):
                        other[at] = rng.choice(["", rng.choice("qxzé"), other[at] + rng.choice("qxz")])
                    other = "".join(other)
                    if norm(other) != norm(line) and edit(norm(line), norm(other)) <= 0.1 * max(len(norm(line)), len(norm(other))) + 1e-9:
                        break
                rows.append((len(rows), line + "\n" + other))
                kinds.append((n, edits, len(norm(line))))
    got = {r["doc_id"]: r["removed"] for r in line_dedup.fuzzy_line_dedup(docs_of(rows)).collect()}
    missed = [kinds[d] for d in got if got[d] != [1]]
    assert not [k for k in missed if k[2] < 18]
    assert not [k for k in missed if k[1] == 1]
    every, lost = Counter(k[0] for k in kinds if k[1] <= 0.06 * k[2]), Counter(k[0] for k in missed if k[1] <= 0.06 * k[2])
    assert all(lost[n] <= 0.1 * every[n] for n in every), (every, lost)


def test_sketches_tell_lines_apart():
    """Of unlike lines hardly any pair is left to edit distances, of edited lines nearly every one."""
    rng = random.Random(51)
    syllables = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", " "]) for _ in range(60)]
    lines = ["".join(rng.choice(syllables) for _ in range(150)) for _ in range(300)]
    edited = ["".join(rng.choice("qxz") if rng.random() < 0.05 else c for c in x) for x in lines]
    raw, offs = _text.texts(pa.array(lines + edited))
    sketch = line_dedup.sketches(raw, offs[:-1], offs[1:]).view(np.uint64)
    i, j = np.triu_indices(300, 1)
    unlike = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= line_dedup.FAR
    alike = np.bitwise_count(sketch[:300] ^ sketch[300:]).sum(1) <= line_dedup.FAR
    assert unlike.mean() < 0.02, unlike.mean()
    assert alike.mean() > 0.98, alike.mean()


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_buckets_in_parts(held, monkeypatch):
    """Buckets of packed keys against brute force, with parts gone through at once and in many turns."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    rng = random.Random(held)
    rows = [(p, rng.randrange(40), rng.randrange(-30, 30)) for p in range(4) for _ in range(150)] + [(9, 5, 3)] * 4 + [(9, 6, i) for i in range(60)]
    groups = defaultdict(set)
    for part, key, node in rows:
        groups[(part << 32) + key].add(node)
    blobs = [(p, [r for r in rows if r[0] == p][at : at + 7]) for p in (0, 1, 2, 3, 9) for at in range(0, 150, 7)]
    blobs = [(p, np.array([k for _, k, _ in b], np.uint32).tobytes() + np.array([n for _, _, n in b], np.int64).tobytes()) for p, b in blobs if b]

    class Rows:
        repartition = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, run, _):
            step = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs[i : i + 5]], pa.int32()), pa.array([d for _, d in blobs[i : i + 5]], pa.binary())], ["part", "data"]) for i in range(0, len(blobs), 5)]
            return pa.Table.from_batches(run(iter(step)), pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("least", pa.int64())])).to_pylist()

    got, links = defaultdict(set), []
    for r in line_dedup.shared_in_parts(Rows()):
        got[r["bucket"]].add(r["node"])
        links.append(((r["bucket"], r["node"]), (r["bucket"], r["least"])))
    assert got == {b: g for b, g in groups.items() if len(g) > 1}
    root = components({(b, n) for b, g in got.items() for n in g}, links)
    assert all(len({root[b, n] for n in g}) == 1 for b, g in got.items())


def test_normal_forms_by_hand_in_little_memory():
    odd = [None, "", "\n", "a\n", "\na", "--", "A9 é.\n\n x ", "日本 語", "  ", " a b ", None]
    rng = random.Random(41)
    odd += ["".join(rng.choice("aB7 é.\n日") for _ in range(rng.randrange(30))) for _ in range(300)]
    x = line_dedup.normalised(*_text.texts(pa.array(odd)))
    every = [(row, number, norm(line)) for row, t in enumerate(odd) for number, line in enumerate(t.split("\n") if t else [])]
    assert list(zip(x.row.tolist(), x.number.tolist(), strict=True)) == [k[:2] for k in every]
    assert x.count.tolist() == [len(t.split("\n")) if t else 0 for t in odd]
    assert [(int(x.row[k]), int(x.number[k]), n.decode()) for k, n in zip(x.some, x.norm, strict=True)] == [k for k in every if k[2]]
    assert x.chars.tolist() == [len(n.decode()) for n in x.norm]
    raw, offs = _text.texts(pa.array(["some Words of 7 letters, in a line. " * 10 + "\n"] * 3000))
    tracemalloc.start()
    line_dedup.normalised(raw, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(raw)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(600):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))
        b = "".join(rng.choice("abc ") if rng.random() < 0.2 else c for c in a)[rng.randrange(3) :] + "".join(rng.choice("ab") for _ in range(rng.randrange(4)))
        for limit in range(6):
            assert line_dedup.edit_within(a, b, limit) == (edit(a, b) <= limit)


def test_fuzzy_lines_of_odd_rows(odd_docs, no_docs):
    rows = line_dedup.fuzzy_line_dedup(odd_docs).collect()
    assert len(rows) == 13
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows if r["doc_id"] in (5, 6)) == [(5, 0), (5, 1), (6, 1)]
    assert line_dedup.fuzzy_line_dedup(no_docs).count() == 0


def test_planted_items_are_found(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], h["item_id"]) for r in decontam.contamination(docs, items).collect() for h in r["hits"]}
    planted = set(duckdb.sql(f"select doc_id, item_id from '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b where contains(d.text, b.text)").fetchall())
    assert planted
    assert planted <= got
    assert len(got - planted) <= 0.05 * len(planted)


def bm25_by_hand(text, items, share, overlap):
    """Every item on which some passage reaches the threshold and both parts' overlap, without any index."""
    tok = lambda s: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), s))
    bags = {i: tok(t) for i, t in items}
    n, seen = len(bags), Counter(x for b in bags.values() for x in set(b))
    mean = sum(map(len, bags.values())) / n
    words, out = tok(text), set()
    for i, bag in bags.items():
        window = 2 << max(6, int(np.ceil(np.log2(len(bag)))))
        weight = {x: np.log1p((n - seen[x] + 0.5) / (seen[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(bag) / mean)) for x, f in Counter(bag).items()}
        head = dict(items)[i].rstrip().rpartition("\n")[0]
        cut = len(tok(head)) if 3 <= len(tok(head)) < len(bag) else None
        spans = [bag] if cut is None else [bag[:cut], bag[cut:]]
        parts = [{tuple(p[k : k + 3]) for k in range(max(1, len(p) - 2))} for p in spans]
        for at in range(0, max(1, len(words) - window // 2), window // 2):
            own = words[at : at + window]
            grams = {tuple(own[k : k + n]) for n in (1, 2, 3) for k in range(len(own) - n + 1)}
            found = [len(p & grams) for p in parts]
            each = all(n >= max(1, min(np.ceil(overlap * len(p)), len(p) - 3 * i)) for i, (n, p) in enumerate(zip(found, parts, strict=True)))
            if sum(weight.get(x, 0) for x in set(own)) >= share * sum(weight.values()) and (each or sum(found) >= 0.8 * sum(map(len, parts))):
                out.add(i)
    return out


def test_search_by_hand():
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(rng.randrange(12, 90))}{rng.choice(' ' + chr(10) * 2)}{say(rng.choice([1, 2, 3, 4, 8, 15]))}") for i in range(40)]
    texts = []
    for _ in range(60):
        words = say(rng.randrange(10, 500)).split()
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                item[rng.randrange(len(item))] = "edit"
            at = rng.randrange(len(words))
            words[at:at] = item
        texts.append(" ".join(words))
    raw, offs = _text.texts(pa.array(texts))
    got = defaultdict(set)
    for index in decontam.build(items, 0.6):
        for row, item, _ in zip(*decontam.search(raw, offs, index, 0.6), strict=True):
            got[row].add(int(index.ids[item]))
    want = {i: bm25_by_hand(t, items, 0.6, 0.6) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 20
    assert {i: got[i] for i in want} == want


def test_scores_do_not_depend_on_the_indexes(docs_of, spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: " ".join(f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    items = [(i, f"{say(rng.randrange(12, 90))}\n{say(rng.randrange(6, 20))}") for i in range(30)]
    docs = docs_of([(i, f"{say(30)} {rng.choice(items)[1]} {say(30)}") for i in range(40)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most in (1 << 20, 2000):
        monkeypatch.setattr(decontam, "INDEX_BYTES", most)
        found.append({r["doc_id"]: [(h["item_id"], round(h["score"], 3)) for h in r["hits"]] for r in decontam.contamination(docs, bench).collect()})
    assert all(found[0].values())
    assert found[0] == found[1]


def test_edited_and_cut_items_are_found():
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' d where length(text) > 2000 and not exists (select 1 from '{SF}/benchmark.parquet' b where contains(d.text, b.text[:40])) limit 20").fetchall()]
    rng, texts, want = random.Random(2), [], []
    for i, t in items:
        words = t.split()
        copies = [[*words[:k], "edited", *words[k + 1 :]] for k in range(0, len(words), 3)] + [words[: int(len(words) * 0.9)]]
        for own in copies:
            around = rng.choice(docs)
            texts.append(f"{around[:700]} {' '.join(own)} {around[700:1500]}")
            want.append((len(texts) - 1, i))
    raw, offs = _text.texts(pa.array(texts))
    got = {(row, int(index.ids[item])) for index in decontam.build(items, 0.6) for row, item, _ in zip(*decontam.search(raw, offs, index, 0.6), strict=True)}
    assert len(set(want) & got) >= 0.98 * len(want)
    assert len(got - set(want)) <= 0.02 * len(want)


def test_a_large_index_skips_and_loses_nothing():
    """Many items in one index, common terms in most of them: the same hits as all scores without bounds."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"c{rng.randrange(30)}" if rng.random() < 0.5 else f"r{rng.randrange(4000)}" for _ in range(n))
    items = [(i, say(rng.randrange(20, 60))) for i in range(900)]
    (index,) = decontam.build(items, 0.6)
    raw, offs = _text.texts(pa.array([say(40) + " " + rng.choice(items)[1] + " " + say(40) for _ in range(30)]))
    term, row = decontam.terms(raw, offs)
    at = np.minimum(np.searchsorted(index.vocabulary, term), len(index.vocabulary) - 1)
    pairs = sorted({(int(r), int(a)) for r, a, t in zip(row, at, term, strict=True) if index.vocabulary[a] == t})
    passage, which = np.array(pairs).T
    weight = defaultdict(float)
    for cell in range(len(index.cell)):
        for post in range(index.postings[cell], index.postings[cell + 1]):
            weight[index.cell[cell] // len(index.lowest), index.item[post]] = float(index.impact[post])
    score = defaultdict(float)
    by_term = defaultdict(list)
    for (t, item), x in weight.items():
        by_term[t].append((item, x))
    for p, t in pairs:
        for item, x in by_term[t]:
            score[p, int(item)] += x
    want = {k for k, x in score.items() if x >= index.least[k[1]] * 0.9999}
    got = decontam.candidates(passage, which, index)
    assert {(int(p), int(i)) for p, i in zip(*got[:2], strict=True)} == want
    assert want


def test_decontamination_of_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "one two", 5), (4, "one two", 5), (4, "one two", 5), (6, "!!!", 5)], "item_id long, text string, kept int")
    rows = decontam.contamination(odd_docs, items).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {-4, 2**62}
    assert decontam.contamination(no_docs, items).count() == 0
    assert all(r["kept"] for r in decontam.contamination(odd_docs, items.limit(0)).collect())


def test_pipeline(spark):
    docs = table(TINY, "documents")
    items = [norm(t) for t in table(TINY, "benchmark")["text"]]
    _, root = near(list(zip(docs["doc_id"], docs["text"], strict=True)))
    want = {d for d in root if root[d] == d}
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    want = {d for d in want if re.search(r"[^\W\d_]", texts[d])}
    clean = {d for d in want if not any(i in norm(texts[d]) for i in items)}
    frame, sf_dir = spark.read.parquet(f"{TINY}/documents.parquet"), TINY
    names = frame.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        frame = stage(spark, frame, sf_dir).cache()
        assert frame.columns == names
        if i == 1:
            assert sorted(r["doc_id"] for r in frame.select("doc_id").collect()) == sorted(want)
    assert sorted(r["doc_id"] for r in frame.select("doc_id").collect()) == sorted(clean)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) <= clean
    assert max(copies.values()) <= 3
    total = sum(len(texts[d].split()) for d in clean)
    assert abs(sum(len(texts[d].split()) * n for d, n in copies.items()) - total) < 0.05 * total
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len({r["shard"] for r in rows if r["doc_id"] == d}) == 1 for d in list(copies)[:20])


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, TINY).count() <= 3 * 13
