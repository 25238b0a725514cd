"""BPE encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A vocabulary file in the format of the tokenizers library is read once in each worker. Encoding
follows the library: special tokens are cut out of the raw text, the rest is normalised (NFC, white
space, lower case), cut into words, and each word's bytes are merged, the lowest rank first and the
leftmost of equal ranks. Words between white space repeat, so each worker keeps a bounded table of
those it has encoded. Python's tables of characters are of another version of Unicode than the
library's; a text with a character that they treat differently is normalised and cut by the library's
own normaliser and splitter, and merged here.

Defined results: a null text is the empty text and has no tokens; decoding no tokens gives the empty
text; repeated rows are encoded again; further columns of the input don't matter; a null doc_id
stays null.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.llm.common import rows_of, table

#: Words kept in a worker's table, and the longest that are kept; the table is emptied when full.
KEPT_WORDS, KEPT_LENGTH = 600_000, 64
CONTROL = re.compile(r"[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next
    one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def merge_symbols(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """ids after all merges. merges: pair -> (rank, id of the merged symbol). The queue has (rank, place
    of the pair's first symbol, merged symbol): the lowest rank first, and the leftmost of equal ones."""
    n = len(ids)
    if n < 2:
        return ids
    merge_of = merges.get
    queue = [(found[0], i, found[1]) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := merge_of(pair)) is not None]
    if not queue:
        return ids
    heapify(queue)
    ids = list(ids)
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    while queue:
        rank, i, new = heappop(queue)
        left, j = ids[i], after[i]
        if left < 0 or j < 0:
            continue  # stale: a neighbour has been merged since
        found = merge_of((left, ids[j]))
        if found is None or found[0] != rank:
            continue
        ids[i], ids[j] = new, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            found = merge_of((new, ids[k]))
            if found is not None:
                heappush(queue, (found[0], i, found[1]))
        h = before[i]
        if h >= 0:
            found = merge_of((ids[h], new))
            if found is not None:
                heappush(queue, (found[0], h, found[1]))
    return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder for a word-level BPE file whose normaliser is NFC, white space to one
    space, lower case, and whose words are the matches of one pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"] is not None:
            raise ValueError(f"{path} has another normaliser, splitter or decoder than this codec")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.same, self.odd = set(map(chr, range(128))), set()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        # the symbol of each byte, in a word and at its end; None outside the vocabulary
        alphabet = byte_alphabet()
        self.symbol = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + self.end) for c in alphabet]
        self.whole = None not in self.symbol and None not in self.last
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.kept_words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """ids of one match of the pattern; symbols outside the vocabulary are left out."""
        found = self.kept_words.get(word)
        if found is None:
            found = self.merged(word)
            if len(word) <= KEPT_LENGTH:
                if len(self.kept_words) >= KEPT_WORDS:
                    self.kept_words.clear()
                self.kept_words[word] = found
        return found

    def merged(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [*map(self.symbol.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return merge_symbols(ids if self.whole else [x for x in ids if x is not None], self.merges)

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """ids of a stretch of normalised text without white space, or of any if the pattern cuts there."""
        words = self.pattern.findall(chunk)
        found = tuple(self.word(words[0])) if len(words) == 1 else tuple([i for w in words for i in self.word(w)])
        if len(chunk) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[chunk] = found
        return found

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # one character at a time, so a final sigma is not told from the others
            text = text.replace("Σ", "σ")
        return text.lower()

    def agrees(self, c: str) -> bool:
        """Whether Python's tables and those of the library give a character the same normal form, class of
        combination and kind. They are of different versions of Unicode."""
        for text in (c, f"e\u0301{c}\u0323x", f"a{c}1{c}!{c} {c}e{c}\u0301"):
            own, theirs = self.normal(text), self.normalizer.normalize_str(text)
            if " ".join(self.chunks(own)) != theirs.strip(" ") or [w for k in self.chunks(own) for w in self.pattern.findall(k)] != [w for w, _ in self.splitter.pre_tokenize_str(theirs)]:
                return False
        return True

    def familiar(self, text: str) -> bool:
        """Whether all characters of the text are alike in both; each is looked at once."""
        for c in set(text).difference(self.same):
            if c in self.odd:
                return False
            (self.same if self.agrees(c) else self.odd).add(c)
            if c in self.odd:
                return False
        return True

    def chunks(self, text: str) -> list[str]:
        """Words between white space. str.split() also cuts at four control characters, which are
        no white space to the file's patterns."""
        return regex.split(r"\s+", text) if CONTROL.search(text) else text.split()

    def parts(self, text: str):
        """(None, text between special tokens) or (id, None)."""
        if not self.special or not any(s in text for s in self.special):
            yield None, text
            return
        at = 0
        for m in self.cut_special.finditer(text):
            if m.start() > at:
                yield None, text[at : m.start()]
            yield self.special[m[0]], None
            at = m.end()
        yield None, text[at:]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for special, part in self.parts(text or ""):
            if special is not None:
                out.append(special)
                continue
            if not part.isascii() and not self.familiar(part):
                for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    out.extend(self.word(word))
                continue
            for chunk in self.chunks(self.normal(part)):
                found = kept.get(chunk)
                out.extend(self.chunk(chunk) if found is None else found)
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings with a space between them, which is what a file without a decoder asks
        for; ids outside the vocabulary are left out."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the ids of each text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the text of each row's ids."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, in one scan."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        own = codec(path)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        out: list[list] = [[], [], [], []]
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = own.encode(text)
            for to, value in zip(out, (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest()), strict=True):
                to.append(value)
            if len(out[0]) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=names)
                out = [[], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
