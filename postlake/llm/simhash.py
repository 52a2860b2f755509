"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a few differing bits.

The search is the tiled exact comparison: distinct fingerprints of a block, ordered by population count, are compared
tile against tile with numpy exclusive-or and bit counts, and tile pairs whose population counts lie further apart
than the radius are skipped; short blocks share their tiles. All tile pairs of a corpus would grow with its square, so blocks come from the pigeonhole
principle: 64 bits are cut into radius + 2 parts; two fingerprints within the radius agree on at least two of them, so
each fingerprint goes to one block for every two parts and no link is lost. Blocks hold distinct fingerprints only:
copies, however many, are one row. A block sends out a spanning forest of its links, never all of them.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like any other;
repeated rows give a row each; null ids have component_id of the smallest id they reach; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, salted_lookup, shuffle_partitions

RADIUS = 4
TILE = 1024
#: Rows of a tile that several short blocks share, and of such tiles that are compared at once.
SHORT, SLAB = 32, 256


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """A bit is 1 if over half the shingles' XXH64 have it; words are lower-cased (A-Z) and split at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        hashes = np.array([xxh64_intdigest(line, seed)], np.uint64)
    else:
        starts = np.concatenate(([0], ends[:-size] + 1))
        hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "uid", "fp"])

    return scan


def join_labels(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lab points each place to its root; returns it with the sets of i and j united pairwise."""
    while True:
        a, b = lab[i], lab[j]
        if not (m := a != b).any():
            return lab
        i, j = i[m], j[m]
        np.minimum.at(lab, np.maximum(a, b)[m], np.minimum(a, b)[m])
        while (up := lab[lab]).tobytes() != lab.tobytes():
            lab = up


def tiled_links(fps: np.ndarray, lab: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """Unites in lab (by the places in at) all of fps within the radius, tile by tile in order of population count."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps, at = fps[order], at[order]
    ones = np.bitwise_count(fps).astype(np.int64)
    for a in range(0, len(fps), TILE):
        left, high = fps[a : a + TILE], ones[min(a + TILE, len(fps)) - 1]
        for b in range(a, len(fps), TILE):
            if ones[b] - high > radius:
                break
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ fps[None, b : b + TILE]) <= radius)
            m = i + a < j + b
            lab = join_labels(lab, at[i[m] + a], at[j[m] + b])
    return lab


def short_blocks(block: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the components within each of many short blocks; rows are in order of block, then population count."""
    n, lab, ones = len(fps), np.arange(len(fps)), np.bitwise_count(fps).astype(np.int64)
    more = -n % SHORT
    tiles, of = np.pad(fps, (0, more)).reshape(-1, SHORT), np.pad(block, (0, more), constant_values=-1).reshape(-1, SHORT)
    ones = np.pad(ones, (0, more)).reshape(-1, SHORT)
    for shift in range(len(tiles)):
        a = np.arange(len(tiles) - shift)
        if shift:
            a = a[(of[a, -1] == of[a + shift, 0]) & (ones[a + shift, 0] - ones[a, -1] <= radius)]
        if not len(a):
            break
        for at in np.array_split(a, -(-len(a) // SLAB)):
            near = np.bitwise_count(tiles[at][:, :, None] ^ tiles[at + shift][:, None, :]) <= radius
            t, i, j = np.nonzero(near & (of[at][:, :, None] == of[at + shift][:, None, :]))
            i, j = at[t] * SHORT + i, (at[t] + shift) * SHORT + j
            m = (i < j) & (j < n)
            lab = join_labels(lab, i[m], j[m])
    return lab


def _cuts(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each part of the 64 bits."""
    ends = [round(64 * k / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def block_forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the components among distinct fingerprints of one block.

    Up to a few tiles are compared in full. Beyond, the pigeonhole principle holds again: cut in radius + 1 parts, links
    agree on one part at least, so only runs of equal parts are compared.
    """
    lab = np.arange(len(fps))
    if len(fps) <= 4 * TILE:
        return tiled_links(fps, lab, lab.copy(), radius)
    for shift, width in _cuts(radius + 1):
        part = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.diff(part[order])) + 1
        for at in np.split(order, ends):
            lab = tiled_links(fps[at], lab, at, radius)
    return lab


def _block_links(radius: int):
    """Batches ordered by block; yields (src, dst) fingerprints. A block that goes on in the next batch is carried over."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(src, dst):
            return pa.record_batch([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

        def found(block, fps):
            order = np.lexsort((np.bitwise_count(fps), block))
            block, fps = block[order], fps[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))
            sizes = np.diff(np.append(starts, len(block)))
            short = np.repeat(sizes <= TILE, sizes)
            parts = [(fps[short], short_blocks(block[short], fps[short], radius))] if short.any() else []
            parts += [(fps[s : s + n], block_forest(fps[s : s + n], radius)) for s, n in zip(starts, sizes, strict=True) if n > TILE]
            for own, lab in parts:
                m = lab != np.arange(len(own))
                if m.any():
                    yield out(own[m], own[lab[m]])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = int(np.searchsorted(block, block[-1]))
            if cut == 0 and held and held[-1][0][-1] == block[-1]:
                held.append((block, fps))
                continue
            done = [*held, (block[:cut], fps[:cut])]
            b, f = (np.concatenate(x) for x in zip(*done, strict=True))
            if len(b):
                yield from found(b, f)
            held = [(block[cut:], fps[cut:])]
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: distinct long column fp. Links (src, dst) whose components are those of all pairs within the radius."""
    cuts = _cuts(radius + 2)
    keys = []
    for k, ((s1, w1), (s2, w2)) in enumerate(combinations(cuts, 2)):
        one = F.shiftrightunsigned("fp", s1).bitwiseAND(F.lit((1 << w1) - 1))
        two = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << w2) - 1))
        keys.append(F.lit(k).cast("long") * F.lit(1 << 40) + one * F.lit(1 << 20) + two)
    rows = prints.select(F.explode(F.array(*keys)).alias("block"), "fp")
    n = shuffle_partitions(prints.sparkSession)
    dealt = rows.repartition(n, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_block_links(radius), "src long, dst long")


def _classes(own: DataFrame, radius: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """own: doc_id, text, uid. Rows (doc_id, uid, fp); fingerprints (fp, class); classes (class, component_id, and uid of the row that stays)."""
    prints = materialize(own.mapInArrow(_fingerprints(shingle), "doc_id long, uid long, fp long"))
    firsts = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    parts = components(near_links(firsts.select("fp"), radius))
    joined = firsts.join(parts, firsts.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    lowest = joined.groupBy("class").agg(F.min("first").alias("first")).select("class", F.col("first.doc_id").alias("component_id"), F.col("first.uid").alias("uid"))
    return prints, joined.select("fp", "class"), lowest


def label_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    prints, classes, lowest = _classes(own, radius, shingle)
    of = salted_lookup(classes, lowest.select("class", "component_id"), ["class"], "fp").select("fp", "component_id")
    return salted_lookup(prints, of, ["fp"], "uid").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class, the one with the smallest id (null last).

    Rows are written once with a number of their own, since a scan planned again may cut the files otherwise.
    """
    rows = materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_uid")))
    own = rows.select(F.col(f"_row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"_row.`{text_col}`").alias("text"), F.col("_uid").alias("uid"))
    stay = _classes(own, radius, shingle)[2].select(F.col("uid").alias("_uid"))
    return rows.join(stay, "_uid", "left_semi").select("_row.*")
