"""Benchmark decontamination by template windows and slot consistency.

A text becomes a row of tokens in two views. The plain view has lower-cased
words and numbers as they stand. The template view puts typed placeholders for
numbers, for units that follow a number and for names (capitalised words inside
a sentence) and keeps what it replaced as slots. It has a second form of windows with a capitalised word
at the start of a sentence: there each one that is no common opener (``OPENERS``) is a name
too. Either form of an item meets either form of a document. Hashes of windows of ``WINDOW`` tokens
are joined with those of the benchmark items. A template window that holds fewer than ``MIN_LITERALS`` words as they
stand is widened to the right until it has them, so questions full of numbers and names match as well; one that
has not got them in ``MAX_WINDOW`` tokens is a bare table and is matched by its plain view. Windows of a document
that lie at one distance from their places in an item form a run. Plain windows always
count. In the template windows of a run an item slot must stand for one document slot, and
a name or unit of the document for one of the item (two numbers may be equal by chance): a
question with other names and numbers in the same places is caught, chance matches of a
template are not. Where slots clash, the pairing of more than half of the places holds, and
windows with a place outside it do not count. A document is contaminated by an item when
the windows that count are ``MIN_SHARE`` of the item's, or ``MIN_RUN`` in one run (20 tokens
at least), or if ``MIN_TOKENS`` of its tokens in a row are found word for word.

Before the join a bitmap of benchmark hashes, of fixed size, is sent to the tasks;
only windows that hit it leave them. It drops no match. A pair of document and item that is
reported shares at least t of the n window places of the item, so it shares one of any n - t + 1: only the
rarest ones of each item start pairs, and the other windows are compared for started pairs alone. An
opening that many questions share starts none.

Defined results: items of fewer than ``MIN_ITEM`` tokens match nothing; shorter ones than a
window are one window of their own length; null and empty texts match nothing;
repeated items each report, repeated rows each count as the same document id and text; very long texts are
read whole; where two pairings of slots tie, neither holds; an empty table of documents or of items finds nothing;
columns other than ids and texts are not read, and ``drop_contaminated`` passes them on.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import as_texts, groups_of, key_column, write_table

WINDOW = 8
MIN_ITEM = 5
MIN_LITERALS = 4
MAX_WINDOW = 32
MIN_SHARE = 0.5
MIN_RUN = 13
MIN_TOKENS = 13
BITMAP_BITS = 24
_WORK_CHARS = 4 << 20
_MAX_LEXICON = 1 << 18

# Units that may follow a number (fixed values).
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound "
    "pounds ounce ounces l ml liter liters litre litres second seconds minute minutes hour hours day days week weeks "
    "month months year years percent dollar dollars euro euros cent cents degree degrees kmh mph".split()
)
# Words that open sentences and are no names (fixed values); words that are both, such as will or may, are left out.
OPENERS = frozenset(
    "a about after all also although an and another any are as at because before both but by can could did do does "
    "during each either every few find first for from had has have he her here his how i if in into is it its "
    "last let many more most my next no not now of often on once one only or other our out over she should since "
    "so some such than that the their then there these they this those though to two under until up was we were what "
    "when where whether which while who whom whose why with would yes yet you your".split()
)
_TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]+|[^\W]+")
_PLACEHOLDERS = {"#": "<number>", "u": "<unit>", "n": "<name>"}
_KINDS = " #un"
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BREAK, _NUMBER, _UNIT, _CAPITAL, _OPENER = 1, 2, 4, 8, 16

_WINDOWS = "id long, key string, view int, size int, hash long, place int, slots array<string>"
_ARROW = pa.schema(
    [("id", pa.int64()), ("key", pa.string()), ("view", pa.int32()), ("size", pa.int32())]
    + [("hash", pa.int64()), ("place", pa.int32()), ("slots", pa.list_(pa.string()))]
)

_RUNS = "key string, id long, item_id long, item_windows int, places array<int>, plain_row int, n_slots int, changed_slots int"
_RUN_ARROW = pa.schema(
    [("key", pa.string()), ("id", pa.int64()), ("item_id", pa.int64()), ("item_windows", pa.int32())]
    + [("places", pa.list_(pa.int32())), ("plain_row", pa.int32()), ("n_slots", pa.int32()), ("changed_slots", pa.int32())]
)


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token, 1)


def _marks(token: str) -> tuple[str, int]:
    """Lower-cased token, and what it can be wherever it stands."""
    first, low = token[0], token.lower()
    if first in ".!?\n":
        return low, _BREAK
    if first.isdigit():
        return low, _NUMBER
    capital = _CAPITAL if first != low[0] and token[1:] == low[1:] else 0
    return low, capital | (_UNIT if low in UNITS else 0) | (_OPENER if low in OPENERS else 0)


def tokens_of(text: str) -> tuple[list[str], dict[int, str], list[int]]:
    """Lower-cased words and numbers, by place the kind of those that templates replace, places of names that open sentences."""
    words: list[str] = []
    kinds: dict[int, str] = {}
    opening: list[int] = []
    fresh = True  # at the start of a sentence
    for low, marks in map(_marks, _TOKEN.findall(text)):
        if marks & _BREAK:
            fresh = True
            continue
        if marks & _NUMBER:
            kinds[len(words)] = "#"
        elif marks & _UNIT and kinds.get(len(words) - 1) == "#":
            kinds[len(words)] = "u"
        elif marks & _CAPITAL:
            if not fresh:
                kinds[len(words)] = "n"
            elif not marks & _OPENER:
                opening.append(len(words))
        fresh = False
        words.append(low)
    return words, kinds, opening


class _Lexicon(dict):
    """Number of each distinct chunk of text between spaces; its tokens, with hash and marks, are found once."""

    def __init__(self) -> None:
        super().__init__()
        self.chars = 0
        self._tokens: dict[str, int] = {}
        self.lows: list[str] = []
        self._hashes, self._marks = array("Q"), array("B")
        self._codes, self._ends = array("i"), array("q", [0])

    def __missing__(self, chunk: str) -> int:
        for token in _TOKEN.findall(chunk):
            code = self._tokens.get(token)
            if code is None:
                low, marks = _marks(token)
                self.lows.append(low)
                self._hashes.append(_hash(low))
                self._marks.append(marks)
                self._tokens[token] = code = len(self._tokens)
            self._codes.append(code)
        self._ends.append(len(self._codes))
        self.chars += len(chunk)
        self[chunk] = number = len(self)
        return number

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token codes of all texts in a row, and how many each text has."""
        # No token holds a space, and a line break only ever stands with what ends sentences.
        chunks = [np.fromiter(map(self.__getitem__, text.replace("\n", " \n ").split(" ")), np.int64) for text in texts]
        ends = np.array(self._ends)
        flat = np.concatenate(chunks) if chunks else np.zeros(0, np.int64)
        first = ends[flat]
        lengths = ends[flat + 1] - first
        after = np.cumsum(lengths)
        at = np.repeat(first - (after - lengths), lengths)
        at += np.arange(len(at))
        counted = np.concatenate([[0], after])[np.cumsum([0, *map(len, chunks)])]
        return np.array(self._codes, np.int32)[at], np.diff(counted)

    def properties(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and marks of each token."""
        return np.array(self._hashes, np.uint64)[codes], np.array(self._marks, np.uint8)[codes]


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0`` to ``base ** (n - 1)``, in 64 bits."""
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums, from zero."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums


class _Windows:
    """Windows of texts, those alone whose hash hits the bitmap if there is one."""

    def __init__(self, sizes: list[int], bitmap: np.ndarray | None) -> None:
        self._sizes, self._bitmap = sizes, bitmap
        self._lexicon = _Lexicon()
        self._placeholders = np.array([0, *(_hash(_PLACEHOLDERS[kind]) for kind in _KINDS[1:])], np.uint64)
        self._up, self._down = _powers(_MULTIPLIER, 0), _powers(1, 0)

    def _hit(self, hashes: np.ndarray) -> np.ndarray:
        if self._bitmap is None:
            return np.ones(hashes.shape, bool)
        at = hashes & np.uint64((1 << BITMAP_BITS) - 1)
        return self._bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

    def _rolled(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the tokens from ``start`` to ``end``, from running sums of token hashes over powers."""
        total = (sums[end] - sums[start]) * self._up[end - 1]
        total ^= total >> np.uint64(29)
        return total * np.uint64(0xBF58476D1CE4E5B9)

    def of(self, texts: list[str], sizes: list[int] | None = None) -> Iterator[tuple[int, int, int, int, int, list[str]]]:
        """``text number, view, size, hash, place, slots`` of each window kept; all texts in one array."""
        if len(self._lexicon) > _MAX_LEXICON or self._lexicon.chars > _WORK_CHARS:
            self._lexicon = _Lexicon()
        lexicon = self._lexicon
        codes, lengths = lexicon.codes(texts)
        number = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        hashes, marks = lexicon.properties(codes)
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (marks[:-1] & _BREAK > 0) | (number[1:] != number[:-1])
        words = marks & _BREAK == 0
        codes, number, hashes, marks, fresh = (x[words] for x in (codes, number, hashes, marks, fresh))
        n = len(codes)
        if not n:
            return
        if n > len(self._up):
            self._up, self._down = _powers(_MULTIPLIER, n), _powers(pow(_MULTIPLIER, -1, 1 << 64), n)
        firsts = np.searchsorted(number, np.arange(len(texts) + 1))
        ends = firsts[number + 1]

        kinds = np.zeros(n, np.int8)
        kinds[(marks & _CAPITAL > 0) & ~fresh] = 3
        numbers = marks & _NUMBER > 0
        after = np.zeros(n, bool)
        after[1:] = numbers[:-1] & (number[1:] == number[:-1])
        units = (marks & _UNIT > 0) & after
        kinds[units] = 2
        kinds[numbers] = 1
        opening = (marks & (_CAPITAL | _OPENER) == _CAPITAL) & fresh & ~units
        # Plain, template, and template with the names that open sentences, if there are any.
        forms = [np.zeros(n, np.int8), kinds]
        if opening.any():
            forms.append(np.where(opening, np.int8(3), kinds))
        n_opening = _sums(opening)
        start = np.arange(n)
        for form, known in enumerate(forms):
            sums = _sums(np.where(known > 0, self._placeholders[known], hashes) * self._down[:n])
            replaced = _sums(known > 0)
            literals = np.flatnonzero(known == 0)
            for size in sizes or self._sizes:
                end = start + size
                if form and size >= WINDOW:
                    last = start - replaced[:-1] + (MIN_LITERALS - 1)  # of the literals from here on
                    whole = last < len(literals)
                    end[whole] = np.maximum(end[whole], literals[last[whole]] + 1)
                    end[~whole] = n + 1
                keep = np.flatnonzero((end <= ends) & (end - start <= MAX_WINDOW))
                to = end[keep]
                if form:
                    # A template without slots says no more than the plain view, the second form without openings than the first.
                    n_replaced = replaced[to] - replaced[keep]
                    good = (n_replaced > 0) & (to - keep - n_replaced >= min(MIN_LITERALS, size - 1))
                    if form == 2:
                        good &= n_opening[to] > n_opening[keep]
                    keep, to = keep[good], to[good]
                rolled = self._rolled(sums, keep, to)
                hit = self._hit(rolled)
                keep, to, rolled = keep[hit], to[hit], rolled[hit].view(np.int64)
                texts_of, places = number[keep], keep - firsts[number[keep]]
                for text, a, b, value, place in zip(*(x.tolist() for x in (texts_of, keep, to, rolled, places))):
                    slots = []
                    if form:
                        at = np.flatnonzero(known[a:b]).tolist()
                        slots = [f"{_KINDS[known[a + i]]}{i}:{lexicon.lows[codes[a + i]]}" for i in at]
                    yield text, min(form, 1), b - a, value, place, slots


def _document_windows(sizes: list[int], bitmap: np.ndarray):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Windows(sizes, bitmap)
        for batch in batches:
            texts = as_texts(batch.column(2))
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts)
            for run in groups_of(rows, map(len, texts), _WORK_CHARS):
                found = [(*run[at][:2], *window) for at, *window in make.of([text for _, _, text in run])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*found) if found else [[]] * 7, _ARROW)], schema=_ARROW
                )

    return windows


def _slot(text: str) -> tuple[int, str, str]:
    """Place in the window, kind and word of a slot."""
    place, _, word = text[1:].partition(":")
    return int(place), text[0], word


def counted_windows(windows: list[tuple[int, int, list[str], list[str]]]) -> tuple[set[int], set[int], set[tuple]]:
    """Item places of the plain and of the consistent template windows of a run, and the slots of the latter.

    Windows are ``view, item_place, item_slots, slots``.
    """
    plain = {place for view, place, _, _ in windows if view == 0}
    bound: dict[int, tuple] = {}  # by place in the item: a run has one document place for each
    templates = []
    for view, place, ours, theirs in windows:
        if view:
            found = []
            for a, b in zip(map(_slot, ours), map(_slot, theirs)):
                bound[place + a[0]] = (a[1:], b[1:])
                found.append(place + a[0])
            templates.append((place, found))
    both, one, other = (Counter(x) for x in (bound.values(), (a for a, _ in bound.values()), (b for _, b in bound.values())))

    def holds(a: tuple, b: tuple) -> bool:
        return 2 * both[a, b] > one[a] and (b[0] == "#" or 2 * both[a, b] > other[b])

    good = {at for at, pair in bound.items() if holds(*pair)}
    kept = [(place, found) for place, found in templates if good.issuperset(found)]
    return plain, {place for place, _ in kept}, {bound[at] for _, found in kept for at in found}


def _longest_row(places: set[int]) -> int:
    """Most places in a row."""
    longest = 0
    for place in places:
        if place - 1 not in places:
            end = place
            while end in places:
                end += 1
            longest = max(longest, end - place)
    return longest


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            windows = [(w["view"], w["item_place"], w["item_slots"], w["slots"]) for w in row["windows"]]
            plain, template, slots = counted_windows(windows)
            if plain or template:
                changed = sum(a != b for a, b in slots)
                rows.append((row["key"], row["id"], row["item_id"], row["item_windows"], sorted(plain | template), _longest_row(plain), len(slots), changed))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, _RUN_ARROW)], schema=_RUN_ARROW
        )


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = _Windows([WINDOW], None)
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1))):
            n = len(tokens_of(text)[0])
            if n >= MIN_ITEM:
                size = min(WINDOW, n)
                rows.extend((i, str(n - size + 1), *window) for _, *window in make.of([text], [size]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _ARROW)], schema=_ARROW
        )


def _as_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the hashes of a task, one line per block of 64 Kbit that has any."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
        for block in np.unique(at >> np.uint64(16)).tolist():
            bits = blocks.setdefault(block, np.zeros(1 << 16, bool))
            bits[(at[at >> np.uint64(16) == block] & np.uint64(0xFFFF)).astype(np.int64)] = True
    for block, bits in blocks.items():
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([block], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]}
        )


def benchmark_bitmap(items: DataFrame) -> np.ndarray:
    """Bits of all window hashes of ``items``: 2 MB, whatever the benchmark."""
    n_blocks = 1 << (BITMAP_BITS - 16)
    found = items.select("hash").repartition(F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1).bitwiseAND(0xFF0000))
    bitmap = np.zeros((n_blocks, 1 << 13), np.uint8)
    for row in found.mapInArrow(_as_bitmap, "block int, bits binary").collect():  # one line per block at most
        bitmap[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return bitmap.reshape(-1)


def _row_key() -> Column:
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.concat(key_column(F.col("doc_id")), F.lit("|"), digest)


def started_pairs(windows: DataFrame, item_side: DataFrame) -> DataFrame:
    """``key, item_id, item_windows`` of all pairs that can be reported, by the rarest window places of each item.

    A reported pair has ``MIN_TOKENS`` tokens in a row in its plain view, or ``MIN_SHARE`` of the places or ``MIN_RUN``
    of them in any view. How often a window is found only ranks the places; any ranking gives the same findings.
    """
    window, item = ["view", "size", "hash"], ["item_id", "item_windows"]
    often = windows.groupBy(*window).agg(F.count("*").alias("n_found"))
    own = write_table(item_side.select(*item, "item_place", *window).join(often, window), "benchmark-found")
    plain = F.when(F.col("view") == 0, F.col("n_found"))
    places = own.repartition(*item).groupBy(*item, "item_place").agg(F.sum("n_found").alias("any"), F.sum(plain).alias("plain"))
    least = {
        "plain": F.lit(MIN_TOKENS - WINDOW + 1),
        "any": F.least(F.ceil(F.col("item_windows") * MIN_SHARE), F.lit(MIN_RUN)),
    }
    of_item = Window.partitionBy(*item)

    def starts(view: str) -> Column:
        # Places that no document has rank first: they count towards the n - t + 1, though they start nothing.
        unseen = F.col("item_windows") - F.count(view).over(of_item)
        rank = unseen + F.row_number().over(of_item.orderBy(F.col(view).asc_nulls_last(), "item_place"))
        return F.col(view).isNotNull() & (rank <= F.col("item_windows") - least[view] + 1)

    chosen = places.select(*item, "item_place", starts("plain").alias("by_plain"), starts("any").alias("by_any"))
    start = (
        own.join(chosen.filter("by_plain or by_any"), [*item, "item_place"])
        .filter("by_any or view = 0")
        .select(*item, *window)
        .distinct()
    )
    return windows.select("key", *window).join(start, window).select("key", *item).distinct()


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, share, longest_run, n_slots, changed_slots``, one row per document and item.

    ``changed_slots`` counts the slots that the document fills in another way, summed over runs: an item
    that repeats its own template meets a copy at several distances.
    Rows of one id and one text are one document.
    """
    return _found(docs, benchmark).drop("key")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = write_table(
        benchmark.select(F.col("item_id").cast("long"), "text").distinct().mapInArrow(_item_windows, _WINDOWS),
        "benchmark-windows",
    )
    size = F.least("size", F.lit(WINDOW)).alias("size")
    sizes = sorted(row["size"] for row in items.select(size).distinct().collect())  # MIN_ITEM to WINDOW
    bitmap = benchmark_bitmap(items)
    narrow = docs.select(F.col("doc_id").cast("long"), _row_key().alias("key"), "text")
    windows = write_table(narrow.mapInArrow(_document_windows(sizes, bitmap), _WINDOWS), "document-windows")
    item_side = items.select(
        F.col("id").alias("item_id"),
        F.col("key").cast("int").alias("item_windows"),
        "view",
        "size",
        "hash",
        F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"),
    )
    pairs = started_pairs(windows, item_side)
    met = (
        pairs.join(item_side, ["item_id", "item_windows"])
        .join(windows.distinct(), ["key", "view", "size", "hash"])
        .filter(F.size("slots") == F.size("item_slots"))
    )
    run = ["key", "id", "item_id", "item_windows", "distance"]
    runs = (
        met.withColumn("distance", F.col("place") - F.col("item_place"))
        .groupBy(*run)
        .agg(F.collect_list(F.struct("view", "item_place", "item_slots", "slots")).alias("windows"))  # those of an item
        .drop("distance")
        .mapInArrow(_runs, _RUNS)
    )
    total = (
        runs.groupBy("key", "id", "item_id", "item_windows")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"),
            F.max(F.size("places")).cast("long").alias("longest_run"),
            F.max("plain_row").alias("plain_row"),
            F.sum("n_slots").alias("n_slots"),
            F.sum("changed_slots").alias("changed_slots"),
        )
        .withColumn("share", F.col("n_windows") / F.col("item_windows"))
    )
    word_for_word = F.col("plain_row") + (WINDOW - 1) >= MIN_TOKENS  # shorter items are one window, all of them
    return total.filter((F.col("share") >= MIN_SHARE) | (F.col("longest_run") >= MIN_RUN) | word_for_word).select(
        "key", F.col("id").alias("doc_id"), "item_id", "n_windows", "share", "longest_run", "n_slots", "changed_slots"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with their own columns."""
    bad = write_table(_found(docs, benchmark).select(F.col("key").alias("_row_key")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("_row"), _row_key().alias("_row_key"))
    return rows.join(bad, "_row_key", "left_anti").select("_row.*")


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
