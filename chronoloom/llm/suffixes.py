"""Removal of long byte strings that occur more than once, with suffix arrays.

A string of ``WINDOW`` bytes is repeated if it starts at two places. Each such
window holds an anchor: the gram of ``GRAM`` bytes with the least hash in it, so
equal windows have equal anchors at equal distances. Spark counts anchors; those
found once cannot lie in a repeated window. The windows of an anchor form one
context (at most ``SPAN`` windows in a row); equal contexts are counted before
the shuffle, and the windows of those found twice are repeated.

The windows of the other contexts are cut into classes by their distance from the
anchor. All windows of a class share a core of bytes around the anchor, so only
contexts with one core can share windows, and in each of their texts the core may
stand as one symbol. A suffix array of these texts (built by linear grouping:
Lyndon groups in descending order, then each group's order) puts equal windows
side by side. A core with too many different texts for one task is split by
halves of its class, each with a longer core.

Contexts, cores and texts are told apart by 128-bit BLAKE2 digests of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common

WINDOW, GRAM = 200, 40
SPAN = WINDOW - GRAM + 1
#: Classes of windows: the least and the greatest distance from their anchor.
CLASSES = ((0, 39), (40, 79), (80, 119), (120, SPAN - 1))
#: A core with more different texts is split.
LIMIT = 200
#: About this many texts share one suffix array.
TEXTS = 2000
#: Bytes of text that are hashed at once.
SLICE = 1 << 19
SHIFT = np.uint64((1 << 21) - 1)
KEYS = "row long, key long"
ANCHORS = "row long, place long, key long, h long, g long"  # place: first window << 16 | anchor's distance << 8 | windows; h and g: the context's digest
SPANS = "array<struct<start:bigint,end:bigint>>"


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of integers, by linear grouping.

    Suffixes start in groups by first symbol. Groups are processed from the
    greatest down: each member's previous smaller suffix is the nearest place to
    its left that is in no processed group, found along the pointers of the places
    between. Those places' prefixes grow by the group's prefix, as many times as
    members point to them, so they leave their group for a new one just above (if
    some stay). Afterwards a group holds the suffixes with one Lyndon prefix. Their
    order is that of the suffixes behind that prefix, so one rising pass puts every
    suffix in its place. Members of a group always rise, and counts are bounded by
    the group's size, so nothing but the alphabet is sorted.
    """
    n = len(text)
    symbols = sorted(set(text))
    number = {s: k for k, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    done = bytearray(n)
    previous = [-1] * n
    ordered: list[list[int]] = []
    g = len(symbols) - 1
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        if own:
            ordered.append(own)
            for i in own:
                done[i] = 1
            count: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            by_count: list[dict[int, list[int]]] = [{} for _ in range(max(count.values(), default=0) + 1)]
            for p, c in count.items():
                by_count[c].setdefault(group[p], []).append(p)
            for moved in reversed(by_count):  # the most repeats first, so that each later group slips in below
                for old, places in moved.items():
                    if len(places) == size[old]:
                        continue  # the whole group moves: it stays where it is
                    new, up = len(members), above[old]
                    members.append(places)
                    size.append(len(places))
                    size[old] -= len(places)
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    for p in places:
                        group[p] = new
        g = below[g]
    slot, starts, at = [0] * n, [], 0
    for k, own in enumerate(reversed(ordered)):
        starts.append(at)  # a group's next free place
        at += len(own)
        for i in own:
            slot[i] = k
    out = [-1] * n
    put = bytearray(n)
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not put[j]:
            put[j] = 1
            s = slot[j]
            out[starts[s]] = j
            starts[s] += 1
            j = previous[j]
    return out


def repeated_windows(texts: list[tuple[bytes, int, bytes]], widths: list[int]) -> list[np.ndarray]:
    """For each text, which of its windows are found in another place of any text.

    A text is the bytes before its core, the core's number and the bytes behind.
    Its windows are all its strings of its width, counted in symbols; texts with
    one core have one width. Each window holds the core.
    """
    symbols: list[int] = []
    starts, counts = [], []
    for (head, core, tail), width in zip(texts, widths, strict=True):
        starts.append(len(symbols))
        counts.append(len(head) + 2 + len(tail) - width)
        symbols += [x + 1 for x in head]
        symbols.append(257 + core)
        symbols += [x + 1 for x in tail]
        symbols.append(0)
    first = np.concatenate(([0], np.cumsum(counts)))
    flat = np.zeros(first[-1], bool)
    # windows by their place among the symbols
    n = np.array(counts, np.int64)
    place = np.arange(first[-1]) - np.repeat(first[:-1] - np.array(starts, np.int64), n)
    number = np.full(len(symbols), -1, np.int64)
    number[place] = np.arange(first[-1])
    order = np.array(suffix_array(symbols), np.int64)
    order = order[number[order] >= 0]
    width = np.repeat(np.array(widths, np.int64), n)[number[order]]
    data = np.array(symbols + [-1] * max(widths, default=0), np.int32)
    # neighbours in the order are equal windows if they agree on a window's symbols
    for low in range(0, len(order) - 1, 50_000):
        a, b = order[low : low + 50_000], order[low + 1 : low + 50_001]
        a, most = a[: len(b)], int(width[low : low + 50_000].max())
        same = np.ones(len(b), bool)
        for k in range(most):
            live = np.flatnonzero(same & (k < width[low : low + len(b)]))
            same[live] = data[a[live] + k] == data[b[live] + k]
        flat[number[a[same]]] = flat[number[b[same]]] = True
    return [flat[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start of the first window, windows, anchor's distance, key) of all contexts in texts laid end to end."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    valid = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(valid):
        return empty, empty, empty, empty
    gram = common.gram_hashes(data, GRAM)
    least = (gram & ~SHIFT) | np.arange(len(gram), dtype=np.uint64)  # of equal grams the first counts
    reach = 1
    while reach < SPAN:
        step = min(reach, SPAN - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    at = (least & SHIFT).astype(np.int64)[valid]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1))))
    base, x = valid[new], at[new]
    return base, np.diff(np.append(new, len(valid))), x - base, gram[x].view(np.int64)


def _slices(texts: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about SLICE bytes; longer texts are cut so that each window lies in one slice."""
    out: list[tuple[int, int, bytes]] = []
    total = 0
    for row, text in texts:
        for at in range(0, max(len(text) - WINDOW + 1, 0), SLICE // 2):
            part = text[at : at + SLICE // 2 + WINDOW - 1]
            if total + len(part) > SLICE:
                yield out
                out, total = [], 0
            out.append((row, at, part))
            total += len(part)
    if out:
        yield out


def _digest(left: int, windows: int, text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16, salt=b"%d,%d" % (left, windows)).digest()


def _find(digests: bool):
    """KEYS of all contexts; or ANCHORS, with the contexts' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for some in _slices(zip(batch.column("row").to_pylist(), map(press.decompress, batch.column("z").to_pylist()), strict=True)):
                sizes = np.array([len(t) for _, _, t in some], np.int64)
                ends = np.cumsum(sizes)
                data = b"".join(t for _, _, t in some)
                base, m, left, key = anchors(np.frombuffer(data, np.uint8), ends)
                which = np.searchsorted(ends, base, "right")
                own = np.array([r for r, _, _ in some], np.int64)[which]
                if not digests:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key)], names=["row", "key"])
                    continue
                inside = base - (ends - sizes)[which] + np.array([a for _, a, _ in some], np.int64)[which]
                found = b"".join(_digest(x, n, data[b : b + n + WINDOW - 1]) for b, n, x in zip(base.tolist(), m.tolist(), left.tolist(), strict=True))
                h, g = np.frombuffer(found, "<i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(inside << 16 | left << 8 | m), pa.array(key), pa.array(h), pa.array(g)], names=["row", "place", "key", "h", "g"])
        common.release()

    return run


def packed(docs: DataFrame) -> DataFrame:
    """row, doc, z as a written table: each row's number, its columns but the text, and its text compressed."""
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc") if names else F.lit(None).cast("int").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    schema = StructType([*(f for f in rows.schema.fields if f.name != "text"), StructField("z", _kind("binary"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in common.sub_batches(batches):
            z = [press.compress(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(z, pa.binary())], names=["doc", "row", "z"])

    return common.written(rows.mapInArrow(run, schema), "packed")


def _kind(name: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(name)


PARTS = "row long, place long, off int, n long, key binary, part binary, near int, far int, l int, m int, head binary, tail binary"
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
NAMES = [x.split()[0] for x in PARTS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], names=NAMES)


def _part(row: int, place: int, off: int, n: int, key: bytes, near: int, far: int, left: int, m: int, head: bytes, tail: bytes) -> tuple:
    """A row of PARTS: ``m`` windows from the distance ``left`` on, of a class with the core ``key``."""
    part = hashlib.blake2b(b"%d,%d,%d," % (left, m, len(head)) + head + tail, digest_size=16, key=key).digest()
    return row, place, off, n, key, part, near, far, left, m, head, tail


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of contexts, from documents with the places of those that are wanted (row, place, n)."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            text = press.decompress(batch.column("z")[k].as_py())
            for p in batch.column("places")[k].as_py():
                base, left, m = p["place"] >> 16, p["place"] >> 8 & 255, p["place"] & 255
                anchor = base + left
                for near, far in CLASSES:  # windows j with near <= left - j <= far
                    low, high = max(0, left - far), min(m - 1, left - near)
                    if low > high:
                        continue
                    # the bytes from ``near`` before the anchor to the first WINDOW - far behind are in each of these windows
                    key = hashlib.blake2b(text[anchor - near : anchor + WINDOW - far], digest_size=16, salt=b"%d" % near).digest()
                    head, tail = text[base + low : anchor - near], text[anchor + WINDOW - far : base + high + WINDOW]
                    out.append(_part(p["row"], p["place"], low, p["n"], key, near, far, left - low, high - low + 1, head, tail))
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)
    common.release()


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part as two, for the halves of its class; their cores grow by bytes of its head and tail."""
    for batch in batches:
        out = []
        for row, place, off, n, key, _, near, far, left, m, head, tail in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
            middle = (near + far) // 2
            for a, b in ((near, middle), (middle + 1, far)):
                low, high = max(0, left - b), min(m - 1, left - a)
                if low > high or a > b:
                    continue
                ahead, behind = a - near, far - b  # the core grows by so many bytes
                core = hashlib.blake2b(b"%d,%d," % (a, b) + head[len(head) - ahead :] + tail[:behind], digest_size=16, key=key).digest()
                out.append(_part(row, place, off + low, n, core, a, b, left - low, high - low + 1, head[low : len(head) - ahead], tail[behind : len(tail) - (m - 1 - high)]))
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, bits) of the parts with a repeated window; they come sorted by key, and whole keys share a suffix array."""
    held: list[tuple[bytes, bytes, bytes, bytes, int]] = []

    def solve() -> pa.RecordBatch:
        cores: dict[bytes, int] = {}
        texts = [(head, cores.setdefault(key, len(cores)), tail) for key, _, head, tail, _ in held]
        found = repeated_windows(texts, [width for *_, width in held])
        some = [(key, part, np.packbits(f).tobytes()) for (key, part, *_), f in zip(held, found, strict=True) if f.any()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*some, strict=True) if some else [[]] * 3)], names=["key", "part", "bits"])

    for batch in batches:
        for key, part, head, tail, near, far in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "head", "tail", "near", "far")), strict=True):
            if len(held) >= TEXTS and key != held[-1][0]:
                yield solve()
            held.append((key, part, head, tail, far - near + 1))
    if held:
        yield solve()
    common.release()


def _decided(parts: DataFrame, limit: int) -> DataFrame:
    """row, place, off, m, bits (null: all m windows) of the parts (a written table) of contexts found once that hold repeated windows."""
    out = None
    while True:
        texts = parts.groupBy("key", "part").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("near", "far", "head", "tail")))
        texts = common.written(texts, "cores")
        keys = texts.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
        keys = common.written(keys, "several")  # so that Spark can split a core that many texts hold
        several = texts.join(keys.where(F.col("d") <= limit), "key").select("key", "part", "head", "tail", "near", "far")
        bits = several.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_decide, "key binary, part binary, bits binary")
        whole = texts.where("n > 1").select("key", "part", F.lit(None).cast("binary").alias("bits"))
        known = common.written(whole.union(bits), "known")
        found = parts.where("n = 1").join(known, ["key", "part"]).select("row", "place", "off", "m", "bits")
        out = found if out is None else out.union(found)
        large = keys.where(F.col("d") > limit).select("key")
        common.forget(texts)
        if large.isEmpty():
            common.forget(keys)
            return out
        parts = common.written(parts.join(large, "key").select(*NAMES).mapInArrow(_halve, PARTS), "halves")
        common.forget(keys)


def _spans(found: list[dict]) -> list[tuple[int, int]]:
    """Maximal (start, end) of the bytes that repeated windows cover."""
    starts = []
    for x in found:
        base = (x["place"] >> 16) + x["off"]
        if x["bits"] is None:  # all windows
            starts.append(np.arange(base, base + x["m"]))
        else:
            starts.append(np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8))) + base)
    at = np.unique(np.concatenate(starts))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > WINDOW)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
    return list(zip(at[first].tolist(), (at[last] + WINDOW).tolist(), strict=True))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, spans = [], []
        for k in range(batch.num_rows):
            if s := _spans(batch.column("found")[k].as_py()):
                rows.append(batch.column("row")[k].as_py())
                spans.append([{"start": a, "end": b} for a, b in s])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["row", "spans"])


def spans(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """row, spans (start, end): the maximal byte runs that repeated windows cover, of documents (row, z) that have any.

    A document's places and decisions are gathered in one row, which is as large
    as a part of the document itself.
    """
    keys = docs.select("row", "z").mapInArrow(_find(False), KEYS)
    repeated = common.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "repeated")
    found = docs.select("row", "z").mapInArrow(_find(True), ANCHORS)
    found = common.written(found.join(repeated, "key"), "anchors")
    common.forget(repeated)
    kinds = found.groupBy("key", "h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min_by("place", "row").alias("place"))
    kinds = common.written(kinds, "contexts")
    several = common.written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("key"), "several")
    wanted = kinds.join(several, "key").groupBy("row").agg(F.collect_list(F.struct("row", "place", "n")).alias("places"))
    parts = common.written(docs.select("row", "z").join(wanted, "row").select("z", "places").mapInArrow(_cut, PARTS), "parts")
    common.forget(several)
    decided = _decided(parts, limit).select("row", "place", "off", "m", "bits")
    # all windows of a context found twice or more are repeated
    often = common.written(kinds.where("n > 1").select("h", "g"), "often")
    whole = found.join(often, ["h", "g"]).select("row", "place", F.lit(0).alias("off"), F.col("place").bitwiseAND(255).cast("int").alias("m"), F.lit(None).cast("binary").alias("bits"))
    hits = whole.union(decided)
    return hits.groupBy("row").agg(F.collect_list(F.struct("place", "off", "m", "bits")).alias("found")).mapInArrow(_merge, f"row long, spans {SPANS}")


def _whole_characters(text: bytes, cut: list[dict]) -> list[dict]:
    """Runs without the parts of UTF-8 characters at their ends."""
    out = []
    for s in cut:
        a, b = s["start"], s["end"]
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append({"start": a, "end": b})
    return out


def cleaned(docs: DataFrame, limit: int = LIMIT, characters: bool = False) -> DataFrame:
    """doc (a struct of the columns of ``docs`` but the text, whatever their names), kept, n_bytes, n_removed, n_spans; see ``dedup``."""
    table = packed(docs)
    joined = table.join(spans(table.select("row", "z"), limit), "row", "left").select("doc", "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            low, size = 0, 0
            kept, total, gone, runs = [], [], [], []
            for k, (z, cut) in enumerate(zip(batch.column("z"), batch.column("spans"), strict=True)):
                text = press.decompress(z.as_py())
                cut = cut.as_py() or []
                cut = _whole_characters(text, cut) if characters else cut
                out, at = [], 0
                for s in cut:
                    out.append(text[at : s["start"]])
                    at = s["end"]
                out.append(text[at:])
                kept.append(b"".join(out))
                total.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                runs.append(len(cut))
                size += len(kept[-1])
                if size > 8_000_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc").slice(low, k + 1 - low), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, gone, runs))], names=["doc", "kept", "n_bytes", "n_removed", "n_spans"])
                    low, size = k + 1, 0
                    kept, total, gone, runs = [], [], [], []
        common.release()

    schema = StructType([joined.schema["doc"], *_kind("kept binary, n_bytes long, n_removed long, n_spans long").fields])
    return joined.mapInArrow(run, schema)


def restored(table: DataFrame, names: list[str], text: Column | None = None) -> list[Column]:
    """The columns ``names`` of a table by ``cleaned``; ``text`` stands for the text."""
    return [text.alias(c) if c == "text" and text is not None else F.col("doc").getField(c).alias(c) for c in names]


def dedup(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Removes each byte covered by a ``WINDOW``-byte string that starts at another place too, in any document.

    Returns ``docs`` without their text, and with these columns, which stand for
    any of ``docs`` with such a name: kept (binary: the remaining bytes, laid end to
    end), n_bytes, n_removed, n_spans (maximal removed runs). All other columns stay,
    whatever their names. Null and empty texts have no bytes; texts shorter than a
    window lose none; of rows with equal texts each loses all that its copies hold
    too, whatever their doc_ids; a text of any length is searched whole, in slices
    that overlap by a window; no rows give no rows. Strings are told apart by
    128-bit digests of their bytes, so hashes alone decide nothing.
    """
    own = ("kept", "n_bytes", "n_removed", "n_spans")
    table = cleaned(docs, limit)
    return table.select(*restored(table, [c for c in docs.columns if c not in ("text", *own)]), *own)


def texts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with the text that ``dedup`` leaves, and all their other columns as they are.

    Characters of which only some bytes are covered stay, so that what remains is
    valid UTF-8. A null text stays null.
    """
    null = docs.withColumn("text", F.col("text").cast("string"))
    marked = null.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("text")).alias("own"), "text")
    table = cleaned(marked, limit, characters=True)
    own = F.col("doc").getField("own")
    text = F.when(~own.getField("text"), F.col("kept").cast("string"))
    return table.select(*[text.alias(c) if c == "text" else own.getField(c).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: what each loses to strings of 200 bytes found elsewhere too, and a digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
