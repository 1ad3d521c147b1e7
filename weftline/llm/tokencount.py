"""Token counts of a byte-level BPE vocabulary, with a shortcut for whole tokens.

Method.  Offline, each string of the vocabulary is encoded by itself; those that
come back as one token and form one pre-token are proven whole.  In the corpus a
text is cut into pre-tokens; whole ones count as one token without any merge, and
the rest are merged by the tokenizer library, each distinct one once for a worker
(a bounded cache).  Texts outside the characters for which both regular-expression
engines are known to agree, and texts with a special token's string, go through the
library entire; so the counts are the library's for every text.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows are
counted each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Pre-tokens whose counts a worker keeps; when full, the cache starts anew.
CACHE_ENTRIES = 600_000
#: The published split pattern of this family of tokenizers, for the characters of PLAIN (of which letters are the word characters but digits and _).
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters of which letter, number and white space are beyond doubt: ASCII text, Latin letters, common punctuation, the euro sign.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\u00C0-\u024F\u2010-\u2027\u20AC]*")
#: A longer pre-token is merged with its text by the library, so that no worker keeps long strings.
LONGEST_CACHED = 64
SCHEMA = "row_key long, n_bytes long, n_tokens long"


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in such vocabularies: printable Latin-1 as it is, the rest from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


def prove_whole(path: str) -> list[str]:
    """Vocabulary strings that alone are one pre-token and encode as one token."""
    tokenizer = load(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    texts = sorted({t for t in texts if t and t not in special and PLAIN.fullmatch(t) and SPLIT.fullmatch(t)})
    return [t for t in texts if len(tokenizer.encode(t, add_special_tokens=False).ids) == 1]


class Counter(dict):
    """Tokens of a pre-token; what is missing is merged by the library's model."""

    def __init__(self, tokenizer, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge, self.letters = whole, tokenizer.model.tokenize, byte_letters()

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode().decode("latin-1").translate(self.letters)))
        if len(piece) <= LONGEST_CACHED:
            if len(self) > CACHE_ENTRIES + len(self.whole):
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class TextCounter:
    def __init__(self, path: str, whole: list[str]):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.counts = Counter(self.tokenizer, whole)

    def __call__(self, text: str) -> int:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.counts.__getitem__, SPLIT.findall(text)))


def _counter(path: str, whole_of):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = TextCounter(path, whole_of.value)
        for batch in batches:
            texts = batch.column(1)
            n_bytes, n_tokens = [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(counter(text) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["row_key", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key, n_bytes and n_tokens of each row; ``path`` is a tokenizer file that every executor has."""
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))
    return docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text")).mapInArrow(_counter(path, whole), SCHEMA)


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op9 for every document."""
    import public_tokenizers

    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path(TOKENIZER)))
    return out.select(F.col("row_key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
