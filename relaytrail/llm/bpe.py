"""Byte-level BPE by recursive SQL: DuckDB runs inside every partition.

Encoding: the distinct pieces of a group of texts become token-position rows. A recursive query
joins neighbouring rows with the merge table, takes each word's leftmost pair of the least rank,
contracts it, and goes on with the words that changed until no pair merges. Long pieces contract all
occurrences of the least pair at once, up to the first whose product would merge earlier; this gives
the same tokens in far fewer rounds. Decoding: token-position rows join the vocabulary, and an
ordered aggregation joins their bytes.

Ranks come from a file of base64 tokens and ranks; the driver reads it and ships its bytes (its size
is that of the vocabulary). Ids are packed as little-endian uint32.

Defined results: a null text is empty and has no ids; decoding no ids gives no bytes; repeated rows
are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relaytrail.llm.common import small_batches
from relaytrail.llm.pieces import PieceEncoder

#: Bytes of text, bytes of new pieces, and tokens to decode that one query takes.
GROUP_BYTES, WORD_BYTES, DECODE_TOKENS = 3 << 19, 1 << 19, 400_000
#: Pieces above this many bytes contract several pairs a round.
LONG = 64
#: Rows of all rounds that one recursive query may keep; the next one goes on from its last round.
KEPT_ROWS = 4_000_000
DUCKDB = {"threads": 1, "memory_limit": "256MB"}

# word and position in one number, position in its low byte; rounds end by themselves (LONG at most)
_SHORT_SQL = """
WITH RECURSIVE steps AS (
  SELECT 0 AS round, place, tok FROM start
  UNION ALL
  SELECT s.round + 1, s.place - (s.place > b.place)::INT, CASE WHEN s.place = b.place THEN b.rank ELSE s.tok END
  FROM steps s JOIN (
    SELECT x.place >> 8 AS word, ((x.place >> 8) << 8) | (min((m.rank::BIGINT << 8) | (x.place & 255)) & 255) AS place,
           (min((m.rank::BIGINT << 8) | (x.place & 255)) >> 8)::INT AS rank
    FROM steps x JOIN steps y ON y.place = x.place + 1
    JOIN pairs m ON m.pair = (x.tok::BIGINT << 32) | y.tok
    GROUP BY x.place >> 8
  ) b ON s.place >> 8 = b.word
  WHERE s.place <> b.place + 1
)
SELECT place, tok FROM steps JOIN (SELECT place >> 8 AS word, max(round) AS round FROM steps GROUP BY place >> 8) last
  ON last.word = steps.place >> 8 AND last.round = steps.round
"""

_LONG_SQL = """
WITH RECURSIVE steps AS (
  SELECT 0 AS round, word, pos, tok FROM start
  UNION ALL
  SELECT round + 1, word, (row_number() OVER (PARTITION BY word ORDER BY pos) - 1)::INT, tok
  FROM (
    SELECT round, word, pos, CASE WHEN hit THEN best ELSE tok END AS tok, lag(hit, 1, false) OVER w AS eaten
    FROM (
      SELECT q.*, chosen AND NOT coalesce(bool_or(early) OVER (PARTITION BY q.word ORDER BY q.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit
      FROM (
        SELECT p.*, p.chosen AND (coalesce(ml.rank < p.best, false) OR coalesce(mr.rank < p.best, false)) AS early
        FROM (
          SELECT c.*, CASE WHEN lag(chosen, 2, false) OVER v THEN best ELSE lag(tok) OVER v END AS before, lead(tok, 2) OVER v AS after
          FROM (
            SELECT n.*, n.rank = n.best AND (n.pos - n.island) % 2 = 0 AS chosen
            FROM (
              SELECT *, max(CASE WHEN rank IS DISTINCT FROM best THEN pos + 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY pos) AS island
              FROM (
                SELECT r.*, min(rank) OVER (PARTITION BY word) AS best
                FROM (
                  SELECT x.round, x.word, x.pos, x.tok, m.rank
                  FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM steps WHERE round < $rounds) x
                  LEFT JOIN merges m ON m.l = x.tok AND m.r = x.nxt
                ) r
              ) WHERE best IS NOT NULL
            ) n
          ) c WINDOW v AS (PARTITION BY word ORDER BY pos)
        ) p
        LEFT JOIN merges ml ON ml.l = p.before AND ml.r = p.best
        LEFT JOIN merges mr ON mr.l = p.best AND mr.r = p.after
      ) q
    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
  ) WHERE NOT eaten
)
SELECT word, pos, tok, round FROM steps JOIN (SELECT word, max(round) AS round FROM steps GROUP BY word) USING (word, round)
ORDER BY word, pos
"""

_DECODE_SQL = """
SELECT part, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes FROM tokens t JOIN vocabulary v ON t.id = v.id GROUP BY part ORDER BY part
"""


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """A DuckDB connection with the merge table and the vocabulary of one rank file."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks_file.splitlines() if line.strip())}
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.db = duckdb.connect(config=DUCKDB)
        self._table("merges", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())}))
        self.db.execute("CREATE TABLE pairs AS SELECT (l::BIGINT << 32) | r AS pair, rank FROM merges")
        self._table("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.encoder = PieceEncoder(pattern, self.merge_pieces)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merge_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        for long in (False, True):
            group, size = [], 0
            chosen = [i for i, r in enumerate(raw) if (len(r) > LONG) == long]
            for i in chosen:
                group.append(i)
                size += len(raw[i])
                if size > WORD_BYTES:
                    self._merge_group(raw, group, out, long)
                    group, size = [], 0
            self._merge_group(raw, group, out, long)
        return out

    def _merge_group(self, raw: list[bytes], group: list[int], out: list[bytes], long: bool) -> None:
        if not group:
            return
        lengths = np.array([len(raw[i]) for i in group])
        tokens = self.bytes[np.frombuffer(b"".join(raw[i] for i in group), np.uint8)]
        words = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
        places = (np.arange(len(tokens)) - np.repeat(lengths.cumsum() - lengths, lengths)).astype(np.int32)
        if not long:
            self.db.register("start", pa.table({"place": (words.astype(np.int64) << 8) | places, "tok": tokens}))
            got = self.db.execute(_SHORT_SQL).fetchnumpy()
            self.db.unregister("start")
            order = np.argsort(got["place"])
            self._give(got["place"][order] >> 8, got["tok"][order], group, out)
            return
        while len(words):
            rounds = max(4, KEPT_ROWS // len(words))
            self.db.register("start", pa.table({"word": words, "pos": places, "tok": tokens}))
            got = self.db.execute(_LONG_SQL, {"rounds": rounds}).fetchnumpy()
            self.db.unregister("start")
            done = got["round"] < rounds  # the others may have pairs left
            self._give(got["word"][done], got["tok"][done], group, out)
            words, places, tokens = (np.ascontiguousarray(got[c][~done]) for c in ("word", "pos", "tok"))

    @staticmethod
    def _give(word: np.ndarray, tokens: np.ndarray, group: list[int], out: list[bytes]) -> None:
        """Pack the tokens of each word, which stand together and in order."""
        packed = tokens.astype("<u4").tobytes()
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        ends = (4 * np.r_[heads[1:], len(word)]).tolist()
        for w, a, b in zip(word[heads].tolist(), (4 * heads).tolist(), ends):
            out[group[w]] = packed[a:b]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each packed id sequence; a long one is cut into parts that are decoded in order."""
        out = [bytearray() for _ in packed]
        parts, owners, size = [], [], 0

        def run() -> None:
            ids = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts])
            table = pa.table({"part": np.repeat(np.arange(len(parts), dtype=np.int32), sizes), "pos": np.arange(len(ids)), "id": ids.astype(np.int32)})
            self.db.register("tokens", table)
            for part, blob in self.db.execute(_DECODE_SQL).fetchall():
                out[owners[part]] += blob
            self.db.unregister("tokens")
            parts.clear()
            owners.clear()

        for row, data in enumerate(packed):
            ids = np.frombuffer(data, "<u4")
            for at in range(0, len(ids), DECODE_TOKENS):
                parts.append(ids[at : at + DECODE_TOKENS])
                owners.append(row)
                size += len(parts[-1])
                if size >= DECODE_TOKENS:
                    run()
                    size = 0
        if parts:
            run()
        return [bytes(b) for b in out]


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The worker's codec of these ranks; tasks of one worker share it and what it remembers."""
    key = ranks_file, pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """(ids, values) of some batches together, bounded by their bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > GROUP_BYTES:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> tuple[pa.Array, list]:
    return pa.concat_arrays([b.column(0) for b in held]), [v for b in held for v in b.column(1).to_pylist()]


def _bounded(keys: pa.Array, values: list[bytes], names: list[str]) -> Iterator[pa.RecordBatch]:
    at = size = 0
    for i, v in enumerate(values):
        size += len(v)
        if size > GROUP_BYTES or i + 1 == len(values):
            yield pa.RecordBatch.from_arrays([keys[at : i + 1], pa.array(values[at : i + 1], pa.binary())], names)
            at, size = i + 1, 0


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    small_batches(docs.sparkSession, rows=256)
    ranks_file = read_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_file, pattern).encoder
        for keys, texts in _groups(batches):
            yield from _bounded(keys, coder.encode([t or "" for t in texts]), ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, ids)."""
    ranks_file = read_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_file, pattern)
        for batch in batches:
            ids = [v or b"" for v in batch.column(1).to_pylist()]
            at = 0
            for out in _bounded(batch.column(0), coder.decode(ids), ["doc_id", "decoded"]):
                yield pa.RecordBatch.from_arrays(
                    [out.column(0), batch.column(1)[at : at + len(out)], out.column(1)], ["doc_id", "ids", "decoded"]
                )
                at += len(out)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): both steps in one worker, which holds one connection for them."""
    small_batches(docs.sparkSession, rows=256)
    ranks_file = read_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_file, pattern)
        for keys, texts in _groups(batches):
            ids, at = coder.encoder.encode([t or "" for t in texts]), 0
            for out in _bounded(keys, coder.decode(ids), ["doc_id", "decoded"]):
                part = pa.array(ids[at : at + len(out)], pa.binary())
                yield pa.RecordBatch.from_arrays([out.column(0), part, out.column(1)], ["doc_id", "ids", "decoded"])
                at += len(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")
