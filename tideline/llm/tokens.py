"""Token ids of whole texts, with a cache of short segments that is bounded by its bytes and ends with the task."""

from __future__ import annotations

import base64
import contextlib
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices

TOUCHING = re.compile(r" \s|\s ")
CUT = re.compile(r"(?<=\S)(?= \S)")
LINE = "\n"  # a token of its own between segments that have no line break
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 190
LONGEST_CACHED = 48
_encoders: dict[str, SegmentEncoder] = {}


class SegmentEncoder:
    """Encodes texts by segments that a byte-level BPE treats apart.

    The pre-tokenizer always cuts before a single space that stands between two
    characters that are not white space, so the ids of a text are the ids of
    its segments in order. Segments recur, so most come from the cache. New
    segments are encoded from the file's ranks with tiktoken, whose ids are the
    same and which is several times faster on single words; segments that hold
    an added token, and all segments where there is no ranks file beside the
    vocabulary, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.added = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.cache: dict[str, bytes] = {}
        self.room = CACHE_BYTES
        self.ranks = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.line_id = self.ranks.encode_ordinary(LINE)[0]

    def forget(self) -> None:
        self.cache.clear()
        self.room = CACHE_BYTES

    def _learn(self, segments: set[str]) -> None:
        if self.room <= 0:
            self.forget()
        self.room -= sum(map(len, segments)) + ENTRY_BYTES * len(segments)
        plain = self.ranks is not None and not self.added.search(" ".join(segments))
        together = [x for x in segments if LINE not in x] if plain else []
        ids = np.array(self.ranks.encode_ordinary(LINE.join(together)), self.dtype) if together else np.empty(0, self.dtype)
        width, coded, ends = ids.itemsize, ids.tobytes(), np.flatnonzero(ids == self.line_id).tolist() if together else []
        if together and len(ends) == len(together) - 1:
            begins = [0, *[x + 1 for x in ends]]
            for x, a, b in zip(together, begins, [*ends, len(ids)], strict=True):
                self.cache[x] = coded[a * width : b * width]
            segments = segments.difference(together)
        for x in segments:
            self.cache[x] = self._whole(x)

    def _whole(self, text: str) -> bytes:
        if self.ranks is None or self.added.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(ids, self.dtype).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        if TOUCHING.search(text) or text[0] == " " or text[-1] == " ":
            segments = CUT.split(text)
        else:
            first, *rest = text.split(" ")
            segments = [first, *[" " + x for x in rest]]
        found = list(map(self.cache.get, segments))
        if None in found:
            misses = {x for x, y in zip(segments, found, strict=True) if y is None}
            long = {x: self._whole(x) for x in misses if len(x) > LONGEST_CACHED}
            misses.difference_update(long)
            if misses:
                before = len(self.cache)
                self._learn(misses)
                if len(self.cache) < before:  # the cache began anew
                    self._learn({x for x in segments if len(x) <= LONGEST_CACHED} - self.cache.keys())
            get = self.cache.get
            found = [get(x) if y is None and x not in long else y if y is not None else long[x] for x, y in zip(segments, found, strict=True)]
        return np.frombuffer(b"".join(found), self.dtype)


@contextlib.contextmanager
def encoder(path: str) -> Iterator[SegmentEncoder]:
    """The worker's own encoder, which later tasks of the worker use again; its cache ends with the task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    try:
        yield _encoders[path]
    finally:
        _encoders[path].forget()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_token_counts(docs: DataFrame, path: str, **texts: str) -> DataFrame:
    """All columns but the texts, plus the number of token ids of each whole text (null: 0).

    ``texts`` names the count's column and the text that it is of; a column
    that has a count's name is replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in (*texts, *texts.values())]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType()) for out in texts])
    docs = docs.select(*keep, *(F.col(text).alias(f"_text_of_{out}") for out, text in texts.items()))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as coder:
            for batch in slices(batches):
                columns = [batch.column(i) for i in range(len(keep))]
                n = [pa.array([len(coder.ids(x.as_py() or "")) for x in batch.column(len(keep) + i)], pa.int64()) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*columns, *n], names=[*keep, *texts])

    return docs.mapInArrow(count, schema)
