"""Near-duplicate records: an exact set-similarity join over word n-grams by prefix trees."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelake.llm.components import hash_to_min
from issuelake.session import spread, stored

#: Counters of the frequency sketch and bits of the presence bitmap, as powers of two: both grow with the rows between two bounds.
LEAST_BITS, MOST_BITS = 20, 26
LEAST_PRESENCE, MOST_PRESENCE = 16, 28
#: Parts of a sketch that are merged on their own, and sketches that one task merges.
CHUNKS, FAN = 16, 256
#: Grams that a posting bucket should hold, and estimated occurrences from which a gram's postings are split;
#: so many times the median counter is taken for what other grams have added to one.
BUCKET_GRAMS, HOT, NOISE = 3_000_000, 16_000, 2
#: Members of a tree; more become several trees, which each probe meets in turn. Copies of a class that one task pairs with all others.
BLOCK, COPIES = 2_000, 2_000
#: Pairs compared at a time within a bucket.
SLICE = 2_000_000
WORD = re.compile(r"[^\W_]+")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def record_text(title: Column, body: Column) -> Column:
    """Title, line feed, body; a missing part counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to 64-bit hashes of their runs of `size` words; remembers the hashes of words."""

    def __init__(self, size: int, least_words: int):
        self.size, self.least = size, max(size, least_words)
        self.known: dict[str, int] = {}

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, gram) of every occurrence, in order; texts of too few words have none."""
        known, flat, counts = self.known, [], []
        for t in texts:
            words = WORD.findall(t.lower()) if t else []
            if len(words) < self.least:
                counts.append(0)
                continue
            counts.append(len(words))
            for w in words:
                h = known.get(w)
                if h is None:
                    h = xxhash.xxh64_intdigest(w)
                    if len(known) < 2_000_000:
                        known[w] = h
                flat.append(h)
        f = np.array(flat, dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
        k = self.size
        if len(f) < k:
            return owner[:0], f[:0]
        n = len(f) - k + 1
        g = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            g = mix(g * M1 + f[i : i + n])
        inside = owner[:n] == owner[k - 1 :]
        return owner[:n][inside], g[inside]


def starts(owner: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)


def slot_of(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The counter of each gram in a sketch with as many counters as `level`."""
    return (grams >> np.uint64(65 - len(level).bit_length())).astype(np.int64)


def ordered_sets(owner: np.ndarray, grams: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) without repetition, the grams of each text in the global order: rarest level first, then by hash."""
    if not len(grams):
        return owner, grams
    rank = (level[slot_of(grams, level)].astype(np.uint64) << np.uint64(41)) | (grams >> np.uint64(23))
    order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | rank)
    o, g = owner[order], grams[order]
    # hashes that agree in their leading 41 bits are put in order by the rest
    close = np.flatnonzero((o[1:] == o[:-1]) & (g[1:] >> np.uint64(23) == g[:-1] >> np.uint64(23)) & (g[1:] < g[:-1]))
    if len(close):
        exact = np.lexsort((g, level[slot_of(g, level)], o))
        o, g = o[exact], g[exact]
    keep = np.concatenate(([True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])))
    return o[keep], g[keep]


def signatures(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, second) 64-bit sums over the grams of each text: equal texts agree in both."""
    s = starts(owner)
    if not len(s):
        return owner[:0], grams[:0], grams[:0]
    return owner[s], np.add.reduceat(mix(grams), s), np.add.reduceat(mix(grams ^ M3), s)


def need(threshold: float, n: np.ndarray, own: bool) -> np.ndarray:
    """Length of the prefix that has to hold a gram of any similar record: of the smaller one of a pair (own) or of the larger."""
    share = 2 * threshold / (1 + threshold) if own else threshold
    return n - np.ceil(n * share - 1e-9).astype(np.int64) + 1


# ------------------------------------------------------------------- sketches


def _chunks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for i, part in enumerate(np.split(counts.astype(np.uint32), CHUNKS)):
        yield i, zlib.compress(part.tobytes(), 1)


def _merged(rows: DataFrame, merge) -> np.ndarray:
    """The sketches in (chunk, counts) put together by `merge` of two arrays; of bounded size, so the result may reach the driver.

    `rows` is stored. FAN sketches are merged by a task, level by level, so
    that no task receives one from every task of the pass before.
    """

    def add(key, pdf):  # hints would be taken for a kind of function
        total = None
        for b in pdf["counts"]:
            one = np.frombuffer(zlib.decompress(b), dtype=np.uint32)
            total = one if total is None else merge(total, one)
        return pd.DataFrame({"chunk": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = rows.select("chunk", "counts")
    left = rows.count() // CHUNKS
    while left > FAN:
        parts = -(-left // FAN)
        rows = stored(rows.groupBy("chunk", (F.xxhash64("counts", F.monotonically_increasing_id()) % parts).alias("part")).applyInPandas(add, "chunk int, counts binary"))
        left = parts
    done = {r["chunk"]: r["counts"] for r in rows.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()}
    return np.concatenate([np.frombuffer(zlib.decompress(done[i]), dtype=np.uint32) for i in range(CHUNKS)]) if done else np.zeros(0, dtype=np.uint32)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums that stay within 32 bits."""
    return np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32)


def presence(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits with the hashes of all ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            held[slots(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        pairs = list(_chunks(np.packbits(held).view(np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([c for _, c in pairs], pa.binary())], names=["chunk", "counts"])

    got = _merged(stored(ids.mapInArrow(run, "chunk int, counts binary")), np.bitwise_or)
    return got.view(np.uint8) if len(got) else np.zeros(1 << (bits - 3), dtype=np.uint8)


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each id in a presence bitmap of 2^bits bits."""
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def spread_keys(n: int) -> np.ndarray:
    """n integers that hash partitioning by an int column sends to n different partitions of n, so that no two buckets meet in a task.

    They are found by the hash that Spark documents for its hash function
    (Murmur3, seed 42); were it another, the buckets would only lie less evenly.
    """
    keys, at = np.full(n, -1, dtype=np.int64), 0
    while (keys < 0).any():
        x = np.arange(at, at + 16 * n, dtype=np.uint32)
        k = x * np.uint32(0xCC9E2D51)
        h = np.uint32(42) ^ (((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593))
        h = (((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        place = (h ^ (h >> np.uint32(16))).view(np.int32) % n
        fresh, first = np.unique(place, return_index=True)
        open_ = keys[fresh] < 0
        keys[fresh[open_]] = x[first[open_]]
        at += 16 * n
    return keys


# ------------------------------------------------------------------- postings


def pack_postings(owner: np.ndarray, grams: np.ndarray, sig: np.ndarray, level: np.ndarray, threshold: float, buckets: int, words: int, hot: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed postings) of the prefixes of the sets of one batch.

    A packed posting list has the records of the bucket (signature, size,
    bitmap of all grams in `words` words of 64 bits, number of postings) and
    their postings (32 bits of the gram, whether within the shorter prefix).
    """
    s = starts(owner)
    if not len(s):
        return
    sizes = np.diff(np.concatenate((s, [len(owner)])))
    doc = np.repeat(np.arange(len(s)), sizes)
    bit = (grams >> np.uint64(8)) % np.uint64(64 * words)
    one = np.uint64(1) << (bit & np.uint64(63))
    maps = np.stack([np.bitwise_or.reduceat(np.where(bit >> np.uint64(6) == np.uint64(w), one, np.uint64(0)), s) for w in range(words)], axis=1)
    at = np.arange(len(owner)) - s[doc]
    reach = np.flatnonzero(at < need(threshold, sizes, False)[doc])
    own = at[reach] < need(threshold, sizes, True)[doc[reach]]
    doc, g = doc[reach], grams[reach]
    # postings of grams that may be frequent are split into groups, and any two groups meet in a cell of their own:
    # own ones as the first group of it, and all as the second
    parts = np.ones(len(g), dtype=np.int64)
    if len(hot[0]):
        slot = slot_of(g, level)
        near = np.minimum(np.searchsorted(hot[0], slot), len(hot[0]) - 1)
        parts = np.where(hot[0][near] == slot, hot[1][near], 1)
    home = (mix(sig[doc]) % parts.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(doc)), parts)
    other = np.arange(len(again)) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts)
    across = np.flatnonzero(own[again] & (other != home[again]))
    first = np.concatenate((other, home[again[across]]))
    second = np.concatenate((home[again], other[across]))
    own = np.concatenate((own[again] & (other == home[again]), np.ones(len(across), dtype=bool)))
    again = np.concatenate((again, again[across]))
    doc, g = doc[again], g[again]
    cell = mix(g + first.astype(np.uint64) * M1 + second.astype(np.uint64) * M3)
    bucket = (cell % np.uint64(buckets)).astype(np.int64)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64), kind="stable")
    doc, cell, own, bucket = doc[order], cell[order], own[order], bucket[order]
    cuts = np.concatenate((starts(bucket), [len(bucket)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        d = doc[a:b]
        first = starts(d)
        who = d[first]
        held = np.diff(np.concatenate((first, [len(d)])))
        yield int(bucket[a]), b"".join(
            [
                np.array([len(who), b - a], dtype=np.int64).tobytes(), sig[who].tobytes(), maps[who].tobytes(),
                sizes[who].astype(np.uint32).tobytes(), held.astype(np.uint32).tobytes(), (cell[a:b] >> np.uint64(32)).astype(np.uint32).tobytes(), np.packbits(own[a:b]).tobytes(),
            ]
        )


def unpack_postings(blobs: list[bytes], words: int) -> tuple[np.ndarray, ...]:
    """sig, bitmap, size of the records; record, gram, own of the postings. Records of one signature count once."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    base = 0
    for blob in blobs:
        n, m = np.frombuffer(blob, dtype=np.int64, count=2)
        at = 16
        for i, (kind, count) in enumerate(((np.uint64, n), (np.uint64, n * words), (np.uint32, n), (np.uint32, n), (np.uint32, m))):
            parts[i].append(np.frombuffer(blob, dtype=kind, count=count, offset=at))
            at += int(count) * np.dtype(kind).itemsize
        parts[5].append(np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=at), count=int(m)).astype(bool))
        base += int(n)
    sig, maps, size, held, gram, own = (np.concatenate(p) for p in parts)
    record = np.repeat(np.arange(base), held)
    _, first = np.unique(sig, return_index=True)
    kept = np.zeros(base, dtype=bool)
    kept[first] = True
    here = kept[record]
    return sig, maps.reshape(base, words), size.astype(np.int64), record[here], gram[here], own[here]


def posting_pairs(blobs: list[bytes], threshold: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of pairs of one bucket that may be similar.

    They share a gram within their prefixes, their sizes fit, and the bits in
    which their bitmaps differ leave room for the overlap that the threshold
    needs: each such bit is a gram of one of them only, so no similar pair is lost.
    """
    sig, maps, size, record, gram, own = unpack_postings(blobs, words)
    order = np.lexsort((size[record], gram))
    record, gram, own = record[order], gram[order], own[order]
    first = starts(gram)
    end = np.repeat(np.concatenate((first[1:], [len(gram)])), np.diff(np.concatenate((first, [len(gram)]))))
    begin = np.repeat(first, np.diff(np.concatenate((first, [len(gram)]))))
    left = np.flatnonzero(own & (end - begin > 1))
    # records of equal size stand on both sides of each other: start at the first of that size
    key = gram.astype(np.float64) * 2.0**20 + np.minimum(size[record], 2**20 - 1)
    low_end = np.searchsorted(key, key[left], side="left")
    room = end[left] - low_end
    found_a, found_b = [], []
    at = 0
    total = np.cumsum(room)
    while at < len(left):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + SLICE, side="right")))
        l, r = left[at:stop], room[at:stop]
        i = np.repeat(l, r)
        j = np.arange(len(i)) - np.repeat(np.cumsum(r) - r, r) + np.repeat(low_end[at:stop], r)
        x, y = record[i], record[j]
        nx, ny = size[x], size[y]
        ok = (x != y) & (nx >= np.ceil(ny * threshold - 1e-9))
        x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
        apart = np.zeros(len(x), dtype=np.int64)
        for w in range(words):
            apart += np.bitwise_count(maps[x, w] ^ maps[y, w])
        ok = (nx + ny - apart) // 2 >= np.ceil((nx + ny) * (threshold / (1 + threshold)) - 1e-9)
        a, b = sig[x[ok]], sig[y[ok]]
        found_a.append(np.minimum(a, b))
        found_b.append(np.maximum(a, b))
        at = stop
    if not found_a:
        return sig[:0], sig[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=bool)
    return a[keep], b[keep]


# ---------------------------------------------------------------- prefix trees


class PrefixTree:
    """A radix tree of suffixes of ordered gram lists, for finding earlier members with a large enough overlap.

    A node is [run, children, ends, longest, shortest]: the grams of its edge,
    children by first gram, (member, its size) of the lists that end here, the
    most grams that may follow below it in any list, and the least size of any
    list below. Members with a common beginning share nodes, so their partial
    overlap with a probe is counted once.
    """

    def __init__(self):
        self.root: list = [(), {}, [], 0, 1 << 60]

    def add(self, grams: list[int], member: int, size: int) -> None:
        node, at, n = self.root, 0, len(grams)
        while True:
            node[3] = max(node[3], n - at)
            node[4] = min(node[4], size)
            if at == n:
                node[2].append((member, size))
                return
            child = node[1].get(grams[at])
            if child is None:
                node[1][grams[at]] = [tuple(grams[at:]), {}, [(member, size)], 0, size]
                return
            run = child[0]
            same, most = 0, min(len(run), n - at)
            while same < most and run[same] == grams[at + same]:
                same += 1
            if same < len(run):  # cut the edge in two
                rest = [run[same:], child[1], child[2], child[3], child[4]]
                child[0], child[1], child[2] = run[:same], {run[same]: rest}, []
                child[3] = len(rest[0]) + rest[3]
            node, at = child, at + same

    def probe(self, grams: list[int], size: int, threshold: float, overlap: int = 0) -> list[tuple[int, int, int]]:
        """(member, its size, overlap) of all members that share enough grams for the threshold; `overlap` grams are common beforehand.

        A subtree is left as soon as the overlap so far and the least of what
        may follow on either side cannot reach what its smallest list needs.
        """
        place = {g: i for i, g in enumerate(grams)}
        n, share, found = len(grams), threshold / (1 + threshold), []
        stack = [(self.root, overlap, -1)]
        while stack:
            (run, children, ends, longest, shortest), common, last = stack.pop()
            need = share * (size + shortest) - 1e-9
            if common + min(len(run) + longest, n - 1 - last) < need:
                continue
            hits = [place[g] for g in run if g in place]
            if hits:
                common += len(hits)
                last = hits[-1]
            for member, other in ends:
                if common >= share * (size + other) - 1e-9:
                    found.append((member, other, common))
            if children and common + min(longest, n - 1 - last) >= need:
                stack.extend((child, common, last) for child in children.values())
        return found


def _probe_blocks(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Similar pairs of each block: its members come first and fill one tree, then all probes of the block traverse it, members that are probes too among them."""
    key, tree, out, waiting = None, PrefixTree(), [], []

    def probe(i: int, own: list[int]) -> None:
        for other, size, common in tree.probe(own, len(own), threshold):
            if other != i:
                out.append((min(i, other), max(i, other), common, len(own) + size - common))

    for batch in batches:
        for block, part, is_member, is_probe, i, grams in zip(batch["block"], batch["part"], batch["member"], batch["probe"], batch["id"], batch["grams"]):
            if (block, part) != key:
                for held in waiting:
                    probe(*held)
                key, tree, waiting = (block, part), PrefixTree(), []
            own = np.frombuffer(grams, dtype=np.uint64).tolist()
            if is_member:
                tree.add(own, i, len(own))
                if is_probe:
                    waiting.append((i, own))
            else:
                probe(i, own)
        if out:
            yield pd.DataFrame(out, columns=["class_a", "class_b", "common", "either"]).astype("int64")
            out.clear()
    for held in waiting:
        probe(*held)
    if out:
        yield pd.DataFrame(out, columns=["class_a", "class_b", "common", "either"]).astype("int64")


def similar_pairs(records: DataFrame, text: Column, id_col: str = "evidence_id", threshold: float = 0.8, size: int = 5, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the records whose sets of word n-grams have a Jaccard similarity of `threshold` or more. Exact.

    members: id, class_id - records with the same n-grams, counted, are one
    class, named by their least id. pairs: class_a < class_b, common, either
    (grams in both and in either), one row per pair of similar classes.

    1. One pass gives each record a signature, so that a text which a third of
       all rows repeat is one class, and counts all grams in a sketch of bounded
       size. The sketch defines the global order, the rarest grams first; below its
       load per counter all grams look alike, which costs comparisons, not pairs.
    2. A pair must share a gram among the first n - ceil(t n) + 1 of the larger
       record and the first n - ceil(2 t / (1 + t) n) + 1 of the smaller one. A
       second pass sends each record once to every bucket of its prefix grams,
       packed with a bitmap of all its grams; postings of grams that may be frequent
       are split into groups of about HOT, any two of which meet in a cell of their
       own, so that a bucket stays of the size of BUCKET_GRAMS. Sizes and bitmaps rule out nearly all pairs of a bucket,
       and never a similar one.
    3. Records left with partners are put into blocks, one for all records that
       have the same least partner, or are it: the partners of all of them fill one
       prefix tree of whole ordered lists, and each of them traverses it. Partial
       overlaps are shared between members, subtrees are pruned by the lengths
       that remain, and the overlap found decides. A list is sent to a block once,
       however many of its pairs meet there. Lists are made in a third pass, for
       the records concerned. A block of very many members becomes several trees.

    Records with fewer than max(size, least_words) words, null and empty texts
    among them, are in no class. Ids are integers; a repeated id is one record
    for each different text; a null id is dropped. Ties need no rule. Columns
    beside the id and the text are not read. N-grams are told apart by 64 bits.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    docs = records.select(F.col(id_col).cast("long").alias("id"), text.cast("string").alias("t")).where("id is not null")
    docs = spread(docs)

    bits = min(MOST_BITS, max(LEAST_BITS, (2 * docs.count()).bit_length()))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch = Shingler(size, least_words), np.zeros(1 << bits, dtype=np.uint32)
        names = ["id", "s1", "s2", "n", "chunk", "counts"]
        for b in batches:
            owner, grams = shingler.grams(b.column(1).to_pylist())
            slot, times = np.unique(slot_of(grams, sketch), return_counts=True)
            sketch[slot] += times.astype(np.uint32)
            who, s1, s2 = signatures(owner, grams)
            n = np.bincount(owner, minlength=b.num_rows)[who] if len(who) else who
            m = len(who)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(who)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names
            )
        c = list(_chunks(sketch))
        none = pa.nulls(len(c), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i for i, _ in c], pa.int32()), pa.array([x for _, x in c], pa.binary())], names=names)

    seen = stored(docs.mapInArrow(survey, "id bigint, s1 bigint, s2 bigint, n bigint, chunk int, counts binary"))
    counts = _merged(seen.where("chunk is not null"), _plus)
    counts = counts if len(counts) else np.zeros(1 << bits, dtype=np.uint32)
    level = np.minimum(np.floor(4 * np.log2(np.maximum(counts, 1))), 127).astype(np.uint8)
    excess = counts - NOISE * float(np.median(counts[counts > 0])) if counts.any() else counts.astype(np.float64)
    often = np.flatnonzero(excess > HOT)
    hot = (often, np.ceil(excess[often] / HOT).astype(np.int64))
    marked = seen.where("chunk is null").select("id", "s1", "s2", "n")
    total, mean = marked.agg(F.sum("n"), F.avg("n")).first()
    buckets = max(6, math.ceil((total or 0) / BUCKET_GRAMS))
    keys = spread_keys(buckets)
    words = math.ceil(3 * (mean or 1) / 64)  # bits enough that few grams of a usual record meet in one
    classes = stored(marked.groupBy("s1", "s2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")))
    members = marked.join(classes, ["s1", "s2"]).select("id", "class_id").distinct()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, least_words)
        for whole in batches:
            for start in range(0, whole.num_rows, 65_536):
                owner, grams = shingler.grams(whole.slice(start, 65_536).column(1).to_pylist())
                who, sig, _ = signatures(owner, grams)
                _, first = np.unique(sig, return_index=True)
                keep = np.zeros(int(who.max()) + 1 if len(who) else 0, dtype=bool)
                keep[who[first]] = True
                kept = keep[owner]
                owner, grams = ordered_sets(owner[kept], grams[kept], level)
                rows = list(pack_postings(owner, grams, sig[np.sort(first)], level, threshold, buckets, words, hot))
                yield pa.RecordBatch.from_arrays([pa.array([keys[r[0]] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "postings"])

    def meet(key, held):
        a, b = posting_pairs(held.column("postings").to_pylist(), threshold, words)
        return pa.table({"sa": a.view(np.int64), "sb": b.view(np.int64)})

    near = docs.mapInArrow(post, "bucket int, postings binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "sa bigint, sb bigint").distinct()
    named = classes.select("s1", "class_id")
    ids = (
        near.join(named.select(F.col("s1").alias("sa"), F.col("class_id").alias("x")), "sa")
        .join(named.select(F.col("s1").alias("sb"), F.col("class_id").alias("y")), "sb")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
    )
    candidates = stored(ids)
    present = min(MOST_PRESENCE, max(LEAST_PRESENCE, (16 * candidates.count()).bit_length()))
    bits = presence(candidates.select("a").union(candidates.select("b")), present)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, least_words)
        for b in batches:
            at = slots(b.column(0).to_numpy(zero_copy_only=False), present)
            b = b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            owner, grams = ordered_sets(*shingler.grams(b.column(1).to_pylist()), level)
            s = starts(owner)
            cuts = np.concatenate((s, [len(owner)])) if len(s) else s
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner[s])), pa.array([grams[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["id", "grams"]
            )

    held = stored(docs.mapInArrow(lists, "id bigint, grams binary").distinct())
    # the least partner of a record, itself included, names its block
    least = candidates.groupBy("b").agg(F.min("a").alias("block")).withColumnRenamed("b", "a")
    met = candidates.join(least, "a", "left").select(F.coalesce("block", "a").alias("block"), "a", "b")
    seats = (
        met.select("block", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(False).alias("member")), F.struct(F.col("b").alias("id"), F.lit(True).alias("member")))).alias("x"))
        .groupBy("block", "x.id").agg(F.max("x.member").alias("member"), F.bool_or(~F.col("x.member")).alias("probe"))
    )
    sized = seats.join(seats.groupBy("block").agg(F.ceil(F.count_if("member") / BLOCK).cast("int").alias("parts")), "block")
    home = F.pmod(F.xxhash64("id"), "parts").cast("int")
    placed = sized.select(
        "block", "id", "probe", F.when(F.col("member"), home).alias("home"), F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(home))).alias("part")
    ).select("block", "part", F.coalesce(F.col("part") == F.col("home"), F.lit(False)).alias("member"), "probe", "id")
    blocks = placed.join(held, "id").select("block", "part", "member", "probe", "id", "grams").repartition("block", "part").sortWithinPartitions("block", "part", F.desc("member"))
    pairs = blocks.mapInPandas(lambda it: _probe_blocks(it, threshold), "class_a bigint, class_b bigint, common bigint, either bigint").groupBy("class_a", "class_b").agg(F.max("common").alias("common"), F.min("either").alias("either"))
    return members, pairs


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id_a < id_b of every two records in similar classes or in one class. A class of very many copies is paired with itself in parts."""
    m = members
    a = m.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    b = m.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = pairs.join(a, "class_a").join(b, "class_b").select("x", "y")
    several = m.join(m.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id", F.ceil(F.col("n") / COPIES).cast("int").alias("parts")), "class_id")
    left = several.select("class_id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("x"))
    right = several.select("class_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("y"))
    within = left.join(right, ["class_id", "part"]).where("x < y").select("x", "y")
    both = across.union(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, class_id, group_id, n_links, group_size: one row per record; a group is a set of classes joined by a chain of similar pairs, named by its least id."""
    links = pairs.select(F.col("class_a").alias("c"), F.col("class_b").alias("d"))
    degree = links.union(links.select("d", "c")).groupBy("c").agg(F.count("*").alias("n_links"))
    comp = hash_to_min(links.select(F.col("c").alias("a"), F.col("d").alias("b")))
    out = (
        members.join(degree, members["class_id"] == degree["c"], "left")
        .join(comp, F.col("class_id") == F.col("node"), "left")
        .select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    sizes = out.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "group_id").select("id", "class_id", "group_id", "n_links", "group_size")
