"""Problem 8: the corpus as ids of a public byte-level BPE vocabulary, encoded by SQL inside each partition.

Texts split into words by the vocabulary's published pattern. A partition's new words go into a DuckDB table, one row a
word with its byte tokens; a recursive query unnests the token positions, joins neighbouring pairs with the merge table,
contracts each word's pair of the least rank, and repeats until no pair is left (USING KEY keeps only a word's last state,
and a step sees only the words that the step before changed). All places of the pair are contracted at once, which is the
same fixpoint, as no merge can come between them; of a pair of equal tokens, whose places overlap, the leftmost is. Ids go
back to their places in the text; ordered aggregation of the vocabulary's bytes decodes. Words met before in the worker
process are not encoded again. The passes are narrow: no shuffle; the vocabulary file is read by each worker process from
its path, which has to exist there; DuckDB has a fixed memory and no folder to spill to.

Null and empty texts give an empty list, null and empty lists the empty text; special tokens' strings are ordinary text.
Ids that are not in the vocabulary decode to nothing, and bytes that are no UTF-8 to the replacement character. Repeated
rows give repeated rows, empty tables none; columns besides the key and the text are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import table

#: Where the public vocabularies lie; a parameter of every function here.
FOLDER = "/opt/tokenizers"
#: The published pattern of this kind of vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers, and words encoded by one query.
KEPT, BATCH = 400_000, 50_000

ENCODE = """
WITH RECURSIVE state(w, ids) USING KEY (w) AS (
  SELECT w, ids FROM words
  UNION
  SELECT s.w, CASE
      WHEN m.a = m.b THEN s.ids[:(best & 1048575) - 1] || [m.c] || s.ids[(best & 1048575) + 2:]
      ELSE [CASE WHEN s.ids[p] = m.a AND s.ids[p + 1] = m.b THEN m.c ELSE s.ids[p] END
            FOR p IN range(1, len(s.ids) + 1) IF p = 1 OR s.ids[p - 1] <> m.a OR s.ids[p] <> m.b] END AS ids
  FROM state s
  JOIN (
    SELECT q.w, min((m.rank << 20) | q.i) AS best
    FROM (SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, unnest(range(1, len(ids))) AS i FROM state WHERE len(ids) > 1) q
    JOIN merges m ON m.a = q.a AND m.b = q.b
    GROUP BY q.w
  ) x ON x.w = s.w
  JOIN merges m ON m.rank = x.best >> 20
)
SELECT w, ids FROM state
"""
#: A place in a word has 20 bits there; a longer word goes in one piece by the same steps with 40 bits.
ENCODE_LONG = ENCODE.replace("m.rank << 20", "CAST(m.rank AS HUGEINT) << 40").replace("best >> 20", "best >> 40").replace("best & 1048575", "CAST(best & 1099511627775 AS BIGINT)")
DECODE = "SELECT d, string_agg(v.hex, '' ORDER BY u.i) AS hex FROM (SELECT d, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM docs) u JOIN vocab v ON v.id = u.id GROUP BY d"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies' files: printable Latin-1 stays, others follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return out


class Encoder:
    """One worker's DuckDB with the merge table, and the words it has met."""

    def __init__(self, name: str, folder: str):
        import duckdb
        import pyarrow as pa
        import regex

        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.split = regex.compile(PATTERN).findall
        self.met: dict[str, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        t = pa.table({"a": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "b": pa.array([vocab[b] for _, b in pairs], pa.int32()), "c": pa.array([vocab[a + b] for a, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int64())})
        self.db.register("given", t)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        letters = {c: b for b, c in byte_letters().items()}
        plain = [(i, bytes(letters[c] for c in t).hex()) for t, i in vocab.items() if all(c in letters for c in t)]
        self.db.register("given", pa.table({"id": pa.array([i for i, _ in plain], pa.int32()), "hex": pa.array([h for _, h in plain])}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        """Encode words not met yet."""
        import pyarrow as pa

        for at in range(0, len(words), BATCH):
            part = words[at : at + BATCH]
            ids = pa.array([[self.first[x] for x in w.encode("utf-8", "surrogatepass")] for w in part], pa.list_(pa.int32()))
            self.db.register("words", pa.table({"w": pa.array(range(len(part)), pa.int32()), "ids": ids}))
            got = self.db.sql(ENCODE if max(map(len, part)) < 1 << 18 else ENCODE_LONG).to_arrow_table()  # 4 bytes a letter at most
            for w, x in zip(got.column("w").to_pylist(), got.column("ids").to_pylist()):
                self.met[part[w]] = x
            self.db.unregister("words")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.met) > KEPT:
            self.met.clear()
        self.learn(list({w for s in split for w in s if w not in self.met}))
        met = self.met
        return [[i for w in s for i in met[w]] for s in split]

    def decode(self, rows) -> list[str]:
        """An Arrow array of lists of ids to their texts."""
        import pyarrow as pa

        self.db.register("docs", pa.table({"d": pa.array(range(len(rows)), pa.int64()), "ids": rows}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("docs")
        out = [""] * len(rows)
        for d, h in zip(got.column("d").to_pylist(), got.column("hex").to_pylist()):
            out[d] = bytes.fromhex(h).decode("utf-8", "replace")
        return out


@lru_cache(maxsize=2)
def encoder(name: str, folder: str) -> Encoder:
    """The worker process's own encoder; tasks after the first find the vocabulary and the met words there."""
    return Encoder(name, folder)


def encode(documents: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids) of every row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(name, folder).encode(b.column(1).to_pylist()), pa.list_(pa.int32()))], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, text) of every row of ids."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 500):  # so many documents are decoded by one query
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder(name, folder).decode(part.column(1)), pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids).cast("array<int>")).mapInArrow(run, f"`{key}` {kind}, text string")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: every document's text, put together again from its ids."""
    return decode(p8_ids(spark, d), "doc_id", "ids")
