"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Documents are range-sorted by id; each range partition encodes its texts and writes one token file, one file of 64-bit
offsets and one of ids. Only the manifest's rows count: a lost or repeated attempt leaves files that nothing names. The
prefix sum of the partitions' totals gives each file its base in the whole corpus. Reading maps a file into memory
(or fetches it, in a store without local files).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Memory
from .store import materialize, new_path

#: A space between two visible characters always starts a new pre-token, so texts can be encoded piece by piece there.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Documents encoded at once, and unknown words in one run.
GROUP = 128
RUN = 256


class TextEncoder:
    """Encodes whole texts with a tokenizer file; equal words are encoded once."""

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        first = self.tokenizer.id_to_token
        # Ids of tokens that begin with a space: in a run of words without inner spaces they begin the words.
        self.begins = np.array([(first(i) or "").startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        self.first = Memory(self._encode, 50_000)
        self.spaced = Memory(self._encode_words)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space: encoded in runs, which are cut again where a token begins with a space."""
        plain = [w for w in words if " " not in w]
        runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)]
        found: dict[str, bytes] = {}
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) == len(run):
                data, bounds = ids.tobytes(), (cuts * ids.itemsize).tolist()
                found.update(zip(run, map(data.__getitem__, map(slice, bounds, [*bounds[1:], len(data)]))))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._encode([" " + w for w in rest])))
        return [found[w] for w in words]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id, as bytes."""
        parts = [self._cut(t or "") for t in texts]
        heads = [p.pop(0) for p in parts]
        self.first.prepare(set(heads))
        self.spaced.prepare(set().union(*parts))
        first, spaced = self.first.young, self.spaced.young
        return [first[h] + b"".join(map(spaced.__getitem__, p)) + self.end for h, p in zip(heads, parts)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        # Words apart by single spaces or line ends, with no other white space: what most texts are.
        words = text.split()
        apart = text.count(" ") + text.count("\n")
        if len(words) - 1 == apart and sum(map(len, words)) + apart == len(text):
            return text.split(" ") if "\n" in text else words
        head, *rest = _CUT.split(text)
        return [head, *(r[1:] for r in rest)]


_encoders: dict[tuple[str, int], TextEncoder] = {}


def _encoder(path: str, end_id: int) -> TextEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = TextEncoder(path, end_id)
    return _encoders[path, end_id]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents; returns the manifest: part, path, dtype, n_docs, n_tokens, base.

    Files stand in the shared folder, in ascending order of id (null ids first, rows of one id by a hash of their text, so
    that a rerun writes the same ids in the same order). Null and empty
    texts have the end id alone. Texts are encoded whole, whatever their length. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_path(spark, "tokens")
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path, end_id)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = _open(folder)
        path = f"{root}/{part:06d}-{name}"
        ids, lengths = [], []
        out = None
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{path}.bin")
            ids.append(batch.column(0))
            texts = batch.column(1)
            for at in range(0, len(texts), GROUP):
                for data in encoder.encode(texts.slice(at, GROUP).to_pylist()):
                    out.write(data)
                    lengths.append(len(data) // encoder.dtype.itemsize)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype("<i8")
        with store.open_output_stream(f"{path}.idx") as f:
            f.write(offsets.tobytes())
        with store.open_output_stream(f"{path}.ids") as f:
            pq.write_table(pa.table({"doc_id": pa.chunked_array(ids)}), f)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "path": [f"{folder}/{part:06d}-{name}"],
                "dtype": [encoder.dtype.str],
                "n_docs": [len(lengths)],
                "n_tokens": [int(offsets[-1])],
            }
        )

    schema = "part int, path string, dtype string, n_docs bigint, n_tokens bigint"
    manifest = materialize(ordered.mapInArrow(write, schema), "token-manifest")
    base = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    return manifest.withColumn("base", base)


def read_tokens(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids before it in the corpus), n_tokens, ids_crc32 of its ids as little-endian 32-bit integers."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, path = _open(row["path"])
                with store.open_input_file(f"{path}.ids") as f:
                    ids = pq.read_table(f).column(0).combine_chunks()
                with store.open_input_file(f"{path}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                if isinstance(store, fs.LocalFileSystem):
                    tokens = np.memmap(f"{path}.bin", row["dtype"], "r")
                else:
                    with store.open_input_file(f"{path}.bin") as f:
                        tokens = np.frombuffer(f.read(), row["dtype"])
                bounds = offsets.tolist()
                crcs = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids if isinstance(ids, pa.Array) else ids.chunk(0),
                        pa.array(offsets[:-1] + row["base"]),
                        pa.array(np.diff(offsets)),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    return spread.mapInArrow(read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
