"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked with other values keeps its
template. Windows of template words are looked up by hash among the windows of the benchmark, and the
placeholders that a document and an item pair up must map one to one: a value of the item always to the
same value of the document and no two to one. Windows that break this do not count.

A number is a word of digits (parts joined by ``.`` or ``,`` are one); a unit is a word or sign of measure or
currency at a number, attached to it or not; a name is a run of capitalised words that do not begin a sentence. An item with fewer template
words than a window is one window of its own. Windows with few literal words say little by themselves: an
item that has no others, but any literal word, is found by its whole template.

Windows of plain lower-cased words are looked up as well, so that a verbatim copy is found whatever its
case, its place or its share of placeholders; an item shorter than a window is found word for word, and
one with fewer than ``LEAST_WORDS`` template words only so.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm import textvec
from jobloom.llm.scratch import fresh, materialize

WINDOW, LEAST_WORDS, LEAST_WINDOWS = 8, 5, 2
#: A window counts if this share of its words stands as it is.
LITERAL_SHARE = 5 / 8
#: The index of a benchmark with up to this many bytes of text is broadcast (some 64 bytes a word).
BROADCAST_BYTES = 4 << 20
#: Added to the size of a window of plain words, and of a window that stands for a whole template.
PLAIN, WHOLE = 16, 32

# Units of measure; those of the metric system are built from their parts.
OTHER_UNITS = (
    "inch inches in foot feet ft yard yards yd mile miles mi ton tons tonne tonnes ounce ounces oz pound pounds lb lbs gallon gallons gal "
    "second seconds sec s minute minutes min hour hours hr h day days week weeks month months year years "
    "cent cents dollar dollars euro euros yen peso pesos usd eur gbp mxn percent degree degrees mph kmh kph kwh acre acres hectare hectares"
)
SIGNS = "% $ € £ ¥ °"
PREFIXES = {"": "", "k": "kilo", "c": "centi", "d": "deci", "m": "milli", "µ": "micro", "n": "nano", "g": "giga", "t": "tera"}
MEASURES = {"m": "meter metre", "g": "gram", "l": "liter litre", "w": "watt", "v": "volt", "hz": "hertz", "j": "joule", "pa": "pascal", "b": "byte"}


def units() -> list[str]:
    """All units in lower case."""
    found = f"{OTHER_UNITS} {SIGNS} °c °f".split()
    for sign, prefix in PREFIXES.items():
        for short, names in MEASURES.items():
            found += [sign + short, *(prefix + name + end for name in names.split() for end in ("", "s"))]
    return found


NUMBER, NAME, UNIT = 1, 2, 3
_KIND = textvec.mix(np.arange(11, 15, dtype=np.uint64))
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?:;\n"]] = True


def _unit_hashes() -> np.ndarray:
    return np.concatenate([w.hash for _, w in textvec.words(pa.array([" ".join(units())]), digits=True)])


def _sign_hashes() -> np.ndarray:
    return np.concatenate([w.hash for _, w in textvec.words(pa.array([SIGNS]), digits=True)])


class Template(NamedTuple):
    """Template words of consecutive texts: hash, kind (0: literal) and value, with text offsets."""

    hash: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    doc: np.ndarray


def templates(column: pa.Array) -> Iterator[Template]:
    unit_words, signs = _unit_hashes(), _sign_hashes()
    for _, w in textvec.words(column, digits=True):
        n = len(w.hash)
        if not n:
            yield Template(w.hash, np.zeros(0, np.uint8), w.hash, w.doc)
            continue
        first_of_text = np.zeros(n + 1, dtype=bool)
        first_of_text[w.doc] = True
        first_of_text = first_of_text[:n]
        head, second = w.raw[w.start], w.raw[np.minimum(w.start + 1, len(w.raw) - 1)]
        size = w.end - w.start
        digit = (head >= 48) & (head <= 57)
        last = w.raw[w.end - 1]
        number = digit & (last >= 48) & (last <= 57)
        # A-Z, or a two-byte capital of Latin-1, Greek or Cyrillic
        capital = (head >= 65) & (head <= 90)
        capital |= (size > 1) & (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        capital |= (size > 1) & (head == 0xCE) & (second >= 0x86) & (second <= 0xAB)
        capital |= (size > 1) & (head == 0xD0) & (second >= 0x80) & (second <= 0xAF)
        ends = np.concatenate(([0], np.cumsum(_END[w.raw])))
        before = np.concatenate(([0], w.end[:-1]))
        opens = first_of_text | (ends[w.start] > ends[before])
        kind = np.zeros(n, dtype=np.uint8)
        kind[capital & ~opens] = NAME
        kind[number] = NUMBER
        previous, following = np.concatenate(([0], kind[:-1])), np.concatenate((kind[1:], [0]))
        last_of_text = np.concatenate((first_of_text[1:], [True]))
        after = np.isin(w.hash, unit_words) & (previous == NUMBER) & ~first_of_text
        kind[after | (np.isin(w.hash, signs) & (following == NUMBER) & ~last_of_text)] = UNIT  # 5 km, 5km, 5%, $5
        previous = np.concatenate(([0], kind[:-1]))
        gap = w.start - before
        joint = w.raw[np.maximum(w.start - 1, 0)]
        joined = (kind == NUMBER) & (previous == NUMBER) & (gap == 1) & ((joint == 46) | (joint == 44))
        joined |= (kind == NAME) & (previous == NAME)
        begin = np.flatnonzero(~(joined & ~first_of_text))
        value = textvec.mix(np.add.reduceat(textvec.mix(w.hash + np.uint64(1)), begin))
        kinds = kind[begin]
        hashed = np.where(kinds == 0, w.hash[begin], _KIND[kinds])
        yield Template(hashed, kinds, value, np.searchsorted(begin, w.doc))


def plain(column: pa.Array) -> Iterator[Template]:
    """Lower-cased words, all literal."""
    for _, w in textvec.words(pc.utf8_lower(column), alnum=True):
        yield Template(w.hash, np.zeros(len(w.hash), np.uint8), w.hash, w.doc)


def _windows(hashed: np.ndarray, literal: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at each place, and whether enough of it is literal (windows may cross texts)."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total += hashed[k : k + n] * textvec._SHINGLE[k]
    sums = np.concatenate(([0], np.cumsum(literal)))
    return textvec.mix(total), sums[size:] - sums[:-size] >= LITERAL_SHARE * size


class Item(NamedTuple):
    id: int
    hash: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    windows: int  #: with enough literal words
    plain: int  #: windows of plain words


def _item_windows(t: Template) -> tuple[int, np.ndarray, np.ndarray]:
    """(code, hashes, places) of the windows of one item's template; code is the size, or stands for the whole."""
    size = min(WINDOW, len(t.hash))
    if size < LEAST_WORDS:
        return WINDOW, t.hash[:0], np.zeros(0, np.int64)
    hashed, ok = _windows(t.hash, t.kind == 0, size)
    at = np.flatnonzero(ok)
    if not len(at) and not t.kind.all():
        sums = np.concatenate(([0], np.cumsum(t.kind == 0)))
        at, size = np.array([np.argmax(sums[size:] - sums[:-size])]), size + WHOLE
    return size, hashed[at], at


def _plain_windows(t: Template) -> tuple[int, np.ndarray, np.ndarray]:
    size = min(WINDOW, len(t.hash))
    hashed = _windows(t.hash, t.kind == 0, size)[0] if size else t.hash
    return size + PLAIN, hashed, np.arange(len(hashed))


def _each(column: pa.Array, of: Callable[[pa.Array], Iterator[Template]]) -> Iterator[Template]:
    """The template of each text."""
    for t in of(column):
        for a, b in zip(t.doc[:-1], t.doc[1:], strict=True):
            yield Template(t.hash[a:b], t.kind[a:b], t.value[a:b], np.array([0, b - a]))


class Index(NamedTuple):
    """Windows of benchmark items: sorted hashes, and (item row, place, code) of each."""

    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray
    items: list[Item]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Index:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        items: list[Item] = []
        texts = pa.array([text for _, text in rows], pa.string())
        for k, (t, w) in enumerate(zip(_each(texts, templates), _each(texts, plain), strict=True)):
            code, hashed, at = _item_windows(t)
            words, word_hashed, word_at = _plain_windows(w)
            items.append(Item(rows[k][0], t.hash, t.kind, t.value.view(np.int64), len(at) if code < WHOLE else 0, len(word_at)))
            for size, found, places in ((code, hashed, at), (words, word_hashed, word_at)):
                for column, value in zip(columns, (found, np.full(len(places), k), places, np.full(len(places), size)), strict=True):
                    column.append(value)
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        order = np.argsort(joined[0], kind="stable")
        return cls(*(c[order] for c in joined), items)

    def met(self, t: Template, code: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, place in the item, place in the texts) of windows that texts share with items."""
        of_code, size = self.size == code, code % PLAIN
        keys, where = self.hash[of_code], np.flatnonzero(of_code)
        hashed, ok = _windows(t.hash, t.kind == 0, size)
        if code >= WHOLE:
            ok = np.ones(len(hashed), dtype=bool)
        low = np.searchsorted(keys, hashed)
        ok &= low < len(keys)
        ok[ok] &= keys[low[ok]] == hashed[ok]
        at = np.flatnonzero(ok)
        doc = np.searchsorted(t.doc, at, side="right") - 1
        inside = at + size <= t.doc[doc + 1]
        at, doc = at[inside], doc[inside]
        if PLAIN <= code < WHOLE and len(at):  # a window that a text repeats says nothing new
            order = np.lexsort((hashed[at], doc))
            at, doc = at[order], doc[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashed[at[1:]] != hashed[at[:-1]])))
            at, doc = at[new], doc[new]
        for place, d, k in zip(at.tolist(), doc.tolist(), low[at].tolist(), strict=True):
            while k < len(keys) and keys[k] == hashed[place]:
                yield d, int(self.item[where[k]]), int(self.place[where[k]]), place
                k += 1


Slots = list[tuple[int, int, int]]  # (kind, value in the item, value in the document)


def _consistent(pairs: list[tuple[int, Slots]]) -> tuple[int, int]:
    """Matched windows whose slots agree, and the slots that hold another value than in the item.

    ``pairs`` are (place in the item, slots) of matched windows.
    """
    votes: dict[tuple[int, int], dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for _, own in pairs:
        for kind, x, y in own:
            votes[kind, x][y] += 1
    chosen: dict[tuple[int, int], int] = {}
    taken: set[tuple[int, int]] = set()
    for (kind, x), found in sorted(votes.items(), key=lambda v: (-max(v[1].values()), v[0])):
        for y in sorted(found, key=lambda v: (v != x, -found[v], v)):
            if (kind, y) not in taken:
                chosen[kind, x] = y
                taken.add((kind, y))
                break
    good = [all(chosen.get((kind, x)) == y for kind, x, y in own) for _, own in pairs]
    places = {at for (at, _), ok in zip(pairs, good, strict=True) if ok}
    changed = {(k, x) for (_, own), ok in zip(pairs, good, strict=True) if ok for k, x, y in own if x != y}
    return len(places), len(changed)


def _whole(t: Template, d: int, at: int, item: Item) -> int | None:
    """Changed slots if the template of ``item`` stands at ``at`` in text ``d``, with slots that map one to one."""
    end = at + len(item.hash)
    if at < t.doc[d] or end > t.doc[d + 1] or not np.array_equal(t.hash[at:end], item.hash):
        return None
    slot = np.flatnonzero(item.kinds)
    ours = t.value[at:end].view(np.int64)
    pairs = set(zip(item.kinds[slot].tolist(), item.values[slot].tolist(), ours[slot].tolist(), strict=True))
    if len({(k, x) for k, x, _ in pairs}) < len(pairs) or len({(k, y) for k, _, y in pairs}) < len(pairs):
        return None
    return sum(x != y for _, x, y in pairs)


def _matches(column: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item id, windows, windows of the item, changed slots) of contaminated texts."""
    codes = np.unique(index.size).tolist()
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    row = 0
    for t in templates(column):
        met: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for code in codes:
            if code < PLAIN:
                for d, item, place, here in index.met(t, code):
                    met[d, item].append((place, here))
            elif code >= WHOLE:
                for d, item, place, here in index.met(t, code):
                    changed = _whole(t, d, here - place, index.items[item])
                    if changed is not None:
                        found[row + d, item] = min(found.get((row + d, item), (1, 1, changed)), (1, 1, changed))
        own = t.value.view(np.int64)
        for (d, item), pairs in met.items():
            _, _, kinds, values, of_item, _ = index.items[item]
            places = range(min(WINDOW, len(kinds)))
            slots = [
                (at, [(int(kinds[at + k]), int(values[at + k]), int(own[here + k])) for k in places if kinds[at + k]])
                for at, here in pairs
            ]
            windows, changed = _consistent(slots)
            if windows >= min(LEAST_WINDOWS, of_item):
                found[row + d, item] = windows, of_item, changed
        row += len(t.doc) - 1
    row = 0
    for t in plain(column):
        shared: dict[tuple[int, int], set[int]] = defaultdict(set)
        for code in codes:
            if PLAIN <= code < WHOLE:
                for d, item, place, _ in index.met(t, code):
                    shared[row + d, item].add(place)
        for pair, at in shared.items():
            item = index.items[pair[1]]
            if (pair not in found or not item.windows) and len(at) >= min(LEAST_WINDOWS, item.plain):
                found[pair] = max(found.get(pair, (0, 0, 0)), (len(at), item.plain, 0))
        row += len(t.doc) - 1
    for (d, item), counts in sorted(found.items()):
        yield d, index.items[item].id, *counts


def _window_rows(texts: pa.Array, codes: list[int] | None) -> Iterator[tuple[int, int, int, int, int, np.ndarray, np.ndarray]]:
    """(row, windows, code, hash, place, slot places and kinds, slot values) of the windows of texts.

    ``codes`` are sizes with what they stand for; None takes those of a benchmark item for each text.
    """
    for layer, of in (0, templates), (PLAIN, plain):
        own = None if codes is None else [c for c in codes if (PLAIN <= c < WHOLE) == bool(layer)]
        if own == []:
            continue
        for row, t in enumerate(_each(texts, of)):
            values = t.value.view(np.int64)
            if own is None:
                sets = [_plain_windows(t) if layer else _item_windows(t)]
            else:
                sets = [(code, *_text_windows(t, code)) for code in own if code % PLAIN <= len(t.hash)]
            for code, hashed, at in sets:
                for h, place in zip(hashed.view(np.int64).tolist(), at.tolist(), strict=True):
                    slot = np.flatnonzero(t.kind[place : place + code % PLAIN])
                    yield row, len(at), code, h, place, slot * 4 + t.kind[place + slot], values[place + slot]


def _text_windows(t: Template, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of one text that may match an item's."""
    hashed, ok = _windows(t.hash, t.kind == 0, code % PLAIN)
    if PLAIN <= code < WHOLE:
        return np.unique(hashed), np.zeros(len(np.unique(hashed)), np.int64)
    if code >= WHOLE:
        sums, size = np.concatenate(([0], np.cumsum(t.kind == 0))), code % PLAIN
        ok = ~ok & (sums[size:] > sums[:-size])
    at = np.flatnonzero(ok)
    return hashed[at], at


def _window_table(texts: DataFrame, codes: list[int] | None) -> DataFrame:
    """Windows of ``texts(key, text)``: ``key, windows, size, hash, place, slots, slot_values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "windows", "size", "hash", "place", "slots", "slot_values"]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        for batch in batches:
            for first in range(0, len(batch), 16):  # bounds the windows held at once
                part = batch.slice(first, 16)
                columns = list(zip(*_window_rows(part.column(1), codes), strict=True)) or [()] * 7
                arrays = [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int64())), *arrays], names=names)

    key = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(
        run, f"key {key}, windows int, size int, hash long, place int, slots array<int>, slot_values array<long>"
    )


def _agreeing(table: pa.Table) -> pa.Table:
    """The one row of a text and an item that share windows, if enough of these agree."""
    pairs: list[tuple[int, Slots]] = []
    shared: set[int] = set()
    of_template = of_words = 0
    for size, of_item, at, slots, x, y in zip(*(table.column(c).to_pylist() for c in ("size", "item_windows", "place", "slots", "theirs", "ours")), strict=True):
        if size < PLAIN:
            of_template = of_item
            pairs.append((at, [(slot % 4, a, b) for slot, a, b in zip(slots, x, y, strict=True)]))
        else:
            of_words = of_item
            shared.add(at)
    windows, changed = _consistent(pairs)
    if not pairs or windows < min(LEAST_WINDOWS, of_template):
        windows, changed, of_template = len(shared), 0, of_words
    row = table.slice(0, 1).select(["key", "item_id"])
    for name, value in (("item_windows", of_template), ("windows", windows), ("changed_slots", changed)):
        row = row.append_column(name, pa.array([value], pa.int32()))
    return row if windows >= max(1, min(LEAST_WINDOWS, of_template)) else row.slice(0, 0)


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(key, item_id, text, item)``, the rows whose text holds the whole template of the item."""
    for batch in batches:
        rows: list[tuple[int, int]] = []
        for k, (text, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            index = Index.of([(0, item)])
            rows += [(k, m[4]) for m in _matches(pa.array([text]), index._replace(**_only_whole(index)))]
        kept = batch.take(pa.array([k for k, _ in rows], pa.int64()))
        one, changed = pa.array([1] * len(rows), pa.int32()), pa.array([c for _, c in rows], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [kept.column(0), kept.column(1), one, one, changed], names=["key", "item_id", "item_windows", "windows", "changed_slots"]
        )


def _only_whole(index: Index) -> dict[str, np.ndarray]:
    own = index.size >= WHOLE
    return {name: getattr(index, name)[own] for name in ("hash", "item", "place", "size")}


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Contaminated ``texts(key, text)`` by a shuffled hash join of windows, for a benchmark of any size.

    Only windows that both sides hold leave the join, so groups hold the windows that one text shares with one item.
    A window that stands for a whole template only makes candidates, whose texts are then compared.
    """
    keyed = items.withColumn("key", F.struct("item_id", F.xxhash64("text").alias("of")))
    theirs = materialize(_window_table(keyed, None), "item-windows")
    codes = [r["size"] for r in theirs.select("size").distinct().collect()]  # at most WINDOW of each kind
    near, whole = [c for c in codes if c < WHOLE], [c for c in codes if c >= WHOLE]
    ours = _window_table(texts, near) if near else _window_table(texts.limit(0), [WINDOW])
    theirs = theirs.select("size", "hash", "slots", F.col("key").alias("item"), "place", F.col("windows").alias("item_windows"), F.col("slot_values").alias("theirs"))
    met = ours.select("key", "size", "hash", "slots", F.col("slot_values").alias("ours")).join(theirs, ["size", "hash", "slots"])
    met = met.select("key", "item", F.col("item.item_id").alias("item_id"), "size", "item_windows", "place", "slots", "theirs", "ours")
    key = texts.schema["key"].dataType.simpleString()
    schema = f"key {key}, item_id long, item_windows int, windows int, changed_slots int"
    found = met.groupBy("key", "item").applyInArrow(_agreeing, schema)
    if not whole:
        return found
    pairs = _window_table(texts, whole).select("key", "size", "hash", "slots").join(theirs, ["size", "hash", "slots"]).select("key", "item").distinct()
    named = keyed.select(F.col("key").alias("item"), F.col("text").alias("of_item"))
    pairs = pairs.join(named, "item").join(texts, "key").select("key", F.col("item.item_id").alias("item_id"), "text", "of_item")
    return found.unionByName(pairs.mapInArrow(_whole_rows, schema))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Distinct ``(item_id, text)``; items with a null id or text match nothing."""
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().distinct()


def benchmark_index(items: DataFrame) -> Index | None:
    """The index of all items, or None if their texts exceed ``BROADCAST_BYTES``."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        return None
    return Index.of([tuple(r) for r in items.orderBy("item_id", "text").collect()])


def _by_text(docs: DataFrame) -> DataFrame:
    """Distinct texts ``(key, text)``; copies share a key of 128 bits."""
    keyed = docs.select(_text_key("text").alias("key"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return keyed.groupBy("key").agg(F.any_value("text").alias("text"))


def _text_key(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold benchmark items: ``doc_id, item_id, windows, item_windows, changed_slots``.

    One row per document and item with at least ``LEAST_WINDOWS`` consistent windows (or all of a shorter
    item), of templates or else of plain words. A whole
    template counts as one window, fewer than verbatim windows of the same item. ``changed_slots`` counts placeholders with another value than in the item: 0 for a verbatim copy.
    Null and empty texts match nothing; texts of any length are searched whole; repeated rows count once; of
    ties between layers the larger counts win; a null doc_id is kept as null; other columns are ignored. The windows
    of a benchmark up to ``BROADCAST_BYTES`` are broadcast, those of a larger one are joined by a shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark_items(benchmark)
    index = benchmark_index(items)
    if index is None:
        ids = texts.select("doc_id", _text_key("text").alias("key"))
        found = ids.join(_joined(_by_text(texts), items), "key").drop("key")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_matches(batch.column(1), shared.value))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                arrays = [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids, *arrays], names=["doc_id", "item_id", "windows", "item_windows", "changed_slots"]
                )

        found = texts.mapInArrow(run, "doc_id long, item_id long, windows int, item_windows int, changed_slots int")
    best = F.max(F.struct("windows", "item_windows", "changed_slots")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; columns are unchanged.

    Rows with a null or empty text stay, repeated rows go or stay together, and without items all stay.
    """
    items = benchmark_items(benchmark)
    index = benchmark_index(items)
    if index is None:
        key, bad = fresh(docs.columns, "_key"), fresh(docs.columns, "_bad")
        gone = _joined(_by_text(docs), items).select(F.col("key").alias(bad)).distinct()
        keyed = docs.withColumn(key, _text_key("text"))
        return keyed.join(gone, keyed[key] == gone[bad], "left_anti").drop(key)
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(len(batch), dtype=bool)
            clean[[m[0] for m in _matches(batch.column(place), shared.value)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
