"""Byte-level BPE by recursive queries: texts to subword ids and back.

Spark deals out the texts; in each task DuckDB does the merges. A batch of texts is
cut at white space, the stretches not met before into words by the pattern of the
vocabulary, and words not met before become rows (word, position, token), one a byte. A recursive query joins neighbours
with the table of merges, contracts each word's leftmost pair of least rank, and ends
when no word has a pair left. Words longer than ``LONG`` bytes contract in one step
all their pairs of least rank, from the left and without overlap, wherever that comes
to the same: ``_long_words``. A word that is a token itself is that token.

Decoding joins tokens with the bytes they stand for and puts them together by an
ordered aggregation. Words and stretches are kept in a bounded memo, so memory depends on the
longest text and not on their number.

Defined results: a null text is an empty one and has no ids. Very long texts and words
are encoded whole. Strings of special tokens are ordinary text. Each row is a document,
also where ids repeat or are null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.llm.common import as_texts, groups_of

# Bytes up to which a word contracts one pair a step.
LONG = 128
MEMO_WORDS = 3 << 17
MEMO_BYTES = 64
# Characters of texts, bytes of new words, and ids that are worked on at a time.
STEP_CHARS = 2_000_000
STEP_BYTES = 200_000
STEP_IDS = 500_000

# The pair of least rank in each word, the leftmost of them, becomes one token; a word without pairs is done.
# ``spot`` is word and place in one number, so one sort serves all words; a rank holds its place in the low bits, so
# that it is the only one of its kind in the word.
_SHORT_WORDS = """
with recursive state as (
  select (word << 16) + pos as spot, id, false as done from pieces
  union all (
  with placed as materialized (
    select spot, id, spot >> 16 as word, lead(spot) over seen as spot2, lead(id) over seen as next, lag(spot) over seen as before
    from state where not done window seen as (order by spot)),
  best as materialized (
    select word, min((m.merged::bigint << 16) + (spot & 65535)) as least
    from placed join merges m on m.l = id and m.r = next and spot2 >> 16 = word group by word)
  select spot, case when spot & 65535 = least & 65535 then (least >> 16)::int else id end, least is null
  from placed left join best using (word)
  where least is null or before is null or before >> 16 <> word or before & 65535 <> least & 65535))
select spot >> 16 as word, spot & 65535 as pos, id from state where done
"""

# All pairs of least rank in each word at once, every second one where they overlap, from the left. Were they
# contracted one by one, a new pair of a lower rank would come before the rest of them: the
# first pair that makes such a one is the last to be contracted in this step.
_LONG_WORDS = """
create or replace temp table contracted as
with pairs as (
  select s.*, m.merged, min(m.merged) over (partition by word) as least
  from (select *, lead(id) over seen as next, lead(id, 2) over seen as after, lag(id) over seen as before,
               row_number() over seen as place
        from pieces window seen as (partition by word order by pos)) s
  left join merges m on m.l = s.id and m.r = s.next),
runs as (
  select *, place - row_number() over (partition by word order by place) as run from pairs where merged = least),
chosen as (
  select * from (select *, row_number() over (partition by word, run order by place) % 2 = 1 as odd from runs) where odd),
checked as (
  select c.*, coalesce(left_pair.merged < c.least, false) or coalesce(right_pair.merged < c.least, false) as lower
  from (select *, lag(place) over (partition by word order by place) = place - 2 as joined from chosen) c
  left join merges left_pair on left_pair.l = case when c.joined then c.merged else c.before end and left_pair.r = c.merged
  left join merges right_pair on right_pair.l = c.merged and right_pair.r = c.after),
taken as (
  select word, place, merged from (
    select *, count(*) filter (lower) over (partition by word order by place
              rows between unbounded preceding and 1 preceding) as earlier from checked)
  where earlier = 0)
select p.word, p.pos, coalesce(t.merged, p.id) as id, p.least is not null as going
from pairs p left join taken t on t.word = p.word and t.place = p.place
left join taken u on u.word = p.word and u.place = p.place - 1
where u.place is null
"""

# Unicode white space (fixed values). No word of a byte-level pattern goes on from another
# character into white space, and only one space opens a word: a text can be cut there.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCHES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")

_DECODED = """
select doc, unhex(string_agg(t.hex, '' order by i.pos)) as bytes from ids i join tokens t on t.id = i.id group by doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: lines of base64 bytes and a number."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens that is a token together: ``l``, ``r`` and ``merged``, their ids."""
    rows = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    pairs = np.array(rows, np.int32).reshape(-1, 3)
    return pa.table({"l": pairs[:, 0], "r": pairs[:, 1], "merged": pairs[:, 2]})


class Coder:
    """Encodes and decodes with one vocabulary, in a DuckDB of its own process."""

    def __init__(self, path: str, pattern: str, memo_words: int = MEMO_WORDS, long: int = LONG) -> None:
        import duckdb
        import regex

        self._ranks = read_ranks(path)
        # White space is what Unicode says it is.
        self._words = regex.compile(pattern).findall
        self._of_byte = np.array([self._ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        # What was met lately; the older half goes when the newer one is full.
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._memo_words = memo_words
        self._long = long
        # Steps are small: nothing is to be put on disk.
        self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        tokens = pa.table({"id": list(self._ranks.values()), "hex": [token.hex() for token in self._ranks]})
        for name, table in (("merges", merge_table(self._ranks)), ("tokens", tokens)):
            self._db.register("given", table)
            self._db.execute(f"create table {name} as select * from given")
            self._db.unregister("given")

    # --- words -----------------------------------------------------------------

    def _merged(self, words: list[bytes], short: bool) -> list[bytes]:
        """Ids of words as little-endian bytes, by joins with the table of merges."""
        letters = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(word) for word in words])
        starts = np.cumsum(lengths) - lengths
        ids = self._of_byte[letters]
        if (ids < 0).any():
            raise ValueError("the vocabulary does not hold every byte")
        word = np.repeat(np.arange(len(words)), lengths)
        pieces = pa.table({"word": word, "pos": np.arange(len(letters)) - starts[word], "id": ids})
        self._db.register("given", pieces)
        self._db.execute("create or replace temp table pieces as select word, pos::bigint as pos, id from given")
        self._db.unregister("given")
        done: list[dict] = []
        if short:
            done.append(self._db.execute(_SHORT_WORDS).fetchnumpy())
        else:
            # A recursive query would keep the rows of every step.
            while len(ids):
                self._db.execute(_LONG_WORDS)
                done.append(self._db.execute("select word, pos, id from contracted where not going").fetchnumpy())
                self._db.execute("create or replace temp table pieces as select word, pos, id from contracted where going")
                if not self._db.execute("select count(*) from pieces").fetchall()[0][0]:
                    break
        word, pos, ids = (np.concatenate([d[name] for d in done]) for name in ("word", "pos", "id"))
        order = np.lexsort((pos, word))
        data = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [data[start:end] for start, end in zip([0, *ends], ends)]

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        known: dict[str, bytes] = {}
        short: list[tuple[str, bytes]] = []
        long: list[tuple[str, bytes]] = []
        for word in words:
            letters = word.encode()
            if letters in self._ranks:
                known[word] = self._ranks[letters].to_bytes(4, "little")
            else:
                (short if len(letters) <= self._long else long).append((word, letters))
        for some, is_short in ((short, True), (long, False)):
            sizes = [len(letters) for _, letters in some]
            for group in groups_of(some, sizes, STEP_BYTES):
                known.update(zip((word for word, _ in group), self._merged([letters for _, letters in group], is_short)))
        return known

    def _learn(self, stretches: set[str]) -> dict[str, bytes]:
        memo = self._memo
        cut = {}
        missing = set()
        for stretch in stretches:
            words = self._words(stretch)
            if len(words) > 1:
                cut[stretch] = words
            missing.update(words)
        missing.difference_update(memo)
        again = {word: self._old[word] for word in missing if word in self._old}
        new = again | self._ids_of(missing.difference(again))
        new |= {
            stretch: b"".join([new[word] if word in new else memo[word] for word in words]) for stretch, words in cut.items()
        }
        return new

    # --- texts -----------------------------------------------------------------

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        for group in groups_of(texts, map(len, texts), STEP_CHARS):
            cut = [_STRETCHES.findall(text) for text in group]
            missing = set().union(*cut).difference(self._memo)
            again = missing.intersection(self._old)
            self._memo.update((stretch, self._old[stretch]) for stretch in again)
            new = self._learn(missing - again)
            self._memo.update(new)
            for stretches in cut:
                yield b"".join(map(self._memo.__getitem__, stretches))
            for word in new:
                if len(word) > MEMO_BYTES:
                    del self._memo[word]
            if len(self._memo) > self._memo_words:
                self._old, self._memo = self._memo, {}

    def decode(self, ids: list[bytes]) -> Iterator[bytes]:
        """The bytes that the ids of each text stand for; an id that is no token is an error."""
        for group in groups_of(ids, (len(i) // 4 for i in ids), STEP_IDS):
            flat = np.frombuffer(b"".join(group), "<u4").astype(np.int32)
            lengths = np.array([len(i) // 4 for i in group])
            if len(flat) and (flat.min() < 0 or not np.isin(np.unique(flat), self._known_ids).all()):
                raise ValueError("an id is no token")
            doc = np.repeat(np.arange(len(group)), lengths)
            self._db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(flat)), "id": flat}))
            found = dict(self._db.execute(_DECODED).fetchall())
            self._db.unregister("ids")
            for i in range(len(group)):
                yield found.get(i, b"")

    @property
    def _known_ids(self) -> np.ndarray:
        return np.fromiter(self._ranks.values(), np.int32)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One coder for each vocabulary in a Python worker."""
    return Coder(path, pattern)


# --- tables ----------------------------------------------------------------------


def _typed(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}"


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids``: the ids of each whole text as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = list(coder(path, pattern).encode(as_texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{_typed(docs, 'doc_id')}, ids binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes``: what the ``ids`` of each row stand for."""

    def run(batches):
        for batch in batches:
            ids = [value or b"" for value in batch.column("ids").to_pylist()]
            texts = list(coder(path, pattern).decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{_typed(encoded, 'doc_id')}, bytes binary")


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row the number of ids and the SHA-256 of the ids and of the bytes decoded from them."""

    def run(batches):
        for batch in batches:
            code = coder(path, pattern)
            ids = list(code.encode(as_texts(batch.column("text"))))
            digests = [hashlib.sha256(some).hexdigest() for some in ids]
            decoded = [hashlib.sha256(some).hexdigest() for some in code.decode(ids)]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(some) // 4 for some in ids], pa.int64()),
                "ids_sha256": pa.array(digests, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"{_typed(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
