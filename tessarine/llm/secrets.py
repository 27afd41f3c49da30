"""Secret scan: strings that a tokenizer's vocabulary compresses badly.

A candidate is a run of at least ``min_length`` characters of ``A-Z a-z 0-9 + / _ -``
(with up to two ``=`` behind it), and where a whole run is no secret, each of its parts of at
least that length between ``+ / _ -``. Candidates that are known not to be secrets are put
aside first:

- numbers: digits with or without separators (card, phone and record numbers);
- UUIDs, and identifiers whose parts are words, words with a short number, and numbers
  (``snake_case_2``, ``a/b/c``);
- digests, alone or as a part: hex of the length of a common hash, unless it is assigned to a
  name like ``password``, ``token`` or ``api_key``, and all strings in ``known_digests``;
- words: letters of one case, or a capital and small letters, whose letters follow each other
  as in the vocabulary's own pieces (a mean log probability of at least ``WORD_FIT`` by pairs).

The rest is a secret if its characters per token are at most ``max_ratio``: a BPE
vocabulary covers words and names in long pieces, random strings in pieces of one or
two characters. Runs are tokenized whole.

Defined results: a null or empty text has no findings. Offsets count characters, from
0. Each row is scanned on its own, so repeated rows have repeated findings; an empty
table gives an empty result. Where docs has a column of the result's name, the result's gets
an underscore.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import _run

#: The public byte-level BPE vocabulary; its folder is a parameter of the deployment.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MASK = "[SECRET]"
#: A single word whose pairs of letters are less likely than this is none.
WORD_FIT = -3.7

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"[0-9+/_\-]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PART = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+")
_PARTS = re.compile(r"[A-Za-z0-9]+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_NAMES = re.compile(r"(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)$", re.I)
#: No name in _NAMES is longer.
_LONGEST_NAME = 16

FINDINGS = "array<struct<start: int, length: int, tokens: int, ratio: double>>"


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoder(ranks: bytes):
    """The tokenizer of a .tiktoken file's content."""
    import tiktoken

    def make():
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=table, special_tokens={})

    return _run.per_worker(f"tiktoken-{len(ranks)}-{hash(ranks)}", make)


def letter_pairs(ranks: bytes) -> dict[str, float]:
    """Log probability of a letter after another inside the vocabulary's pieces, by pairs."""
    pairs, firsts = Counter(), Counter()
    for line in ranks.splitlines():
        try:
            piece = base64.b64decode(line.split()[0]).decode().strip().lower()
        except UnicodeDecodeError:
            continue
        if piece.isascii() and piece.isalpha():
            pairs.update(map("".join, zip(piece, piece[1:], strict=False)))
            firsts.update(piece[:-1])
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: math.log((pairs[a + b] + 0.5) / (firsts[a] + 13)) for a in letters for b in letters}


def fit(word: str, pairs: dict[str, float]) -> float:
    return sum(map(pairs.__getitem__, map("".join, zip(word, word[1:], strict=False)))) / max(len(word) - 1, 1)


def is_assigned(text: str, start: int) -> bool:
    """Whether what begins here is the value of a name like ``password``."""

    def back(at: int, chars: str = "") -> int:
        if chars and at and text[at - 1] in chars:
            return at - 1
        while not chars and at and text[at - 1].isspace():
            at -= 1
        return at

    at = back(back(start, "\"'"))
    sign = back(at, ":=")
    if sign == at:
        return False
    at = back(back(sign), "\"'")
    return bool(_NAMES.search(text[max(0, at - _LONGEST_NAME) : at]))


def is_digest(text: str, start: int, run: str, at: int) -> bool:
    return len(run) in _DIGEST_LENGTHS and bool(_HEX.fullmatch(run)) and not is_assigned(text, at) and not is_assigned(text, start)


def is_known(text: str, start: int, run: str, known_digests: frozenset) -> bool:
    """Whether the run is a number, an identifier or a digest."""
    bare = run.rstrip("=")
    if bare in known_digests or _NUMBER.fullmatch(bare) or _UUID.fullmatch(bare) or is_digest(text, start, bare, start):
        return True
    parts = list(_PARTS.finditer(bare))
    if len(parts) == 1 and len(parts[0].group()) == len(bare):
        return False
    return all(_PART.fullmatch(m.group()) or m.group() in known_digests or is_digest(text, start, m.group(), start + m.start()) for m in parts)


class Scanner:
    """The scan of single texts."""

    def __init__(self, ranks: bytes, min_length: int, max_ratio: float, known_digests: frozenset):
        self.encoding, self.pairs = encoder(ranks), letter_pairs(ranks)
        self.max_ratio, self.known = max_ratio, known_digests
        self.candidate = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % min_length)
        self.part = re.compile(r"[A-Za-z0-9]{%d,}={0,2}" % min_length)

    def secret(self, text: str, start: int, run: str) -> tuple | None:
        """(start, length, tokens, ratio) of a candidate that is one."""
        if is_known(text, start, run, self.known):
            return None
        word = bool(_WORD.fullmatch(run))
        if word and fit(run.lower(), self.pairs) >= WORD_FIT:
            return None
        tokens = len(self.encoding.encode_ordinary(run.lower() if word else run))
        return (start, len(run), tokens, round(len(run) / tokens, 4)) if len(run) <= self.max_ratio * tokens else None

    def __call__(self, text: str | None) -> list[tuple]:
        out = []
        for match in self.candidate.finditer(text or ""):
            start, run = match.start(), match.group()
            if found := self.secret(text, start, run):
                out.append(found)
            elif run not in self.known and not _UUID.fullmatch(run):
                parts = (self.secret(text, start + m.start(), m.group()) for m in self.part.finditer(run) if len(m.group()) < len(run))
                out += filter(None, parts)
        return out


def _finder(path: str, min_length: int, max_ratio: float, known_digests):
    ranks, known = vocabulary(path), frozenset(known_digests)
    key = f"secrets-{hash(ranks)}-{min_length}-{max_ratio}-{hash(known)}"
    return lambda: _run.per_worker(key, lambda: Scanner(ranks, min_length, max_ratio, known))


def scan(
    docs: DataFrame, path: str = VOCABULARY, min_length: int = 16, max_ratio: float = 2.4, known_digests=(), into: str = "secrets"
) -> DataFrame:
    """docs with the findings of each row in the array column ``into``."""
    [into] = _run.fresh(docs, into)
    make = _finder(path, min_length, max_ratio, known_digests)
    _run.text_batches(docs)

    def findings(texts: pa.Array) -> pa.Array:
        look = make()
        _run.give_back()
        keys = ("start", "length", "tokens", "ratio")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("tokens", pa.int32()), ("ratio", pa.float64())]))
        return pa.array([[dict(zip(keys, x, strict=True)) for x in look(t)] for t in texts.to_pylist()], kind)

    return docs.withColumn(into, F.arrow_udf(findings, FINDINGS).asNondeterministic()("text"))


def redact(docs: DataFrame, path: str = VOCABULARY, min_length: int = 16, max_ratio: float = 2.4, known_digests=()) -> DataFrame:
    """docs with every secret replaced by ``[SECRET]``; n_chars follows where a text changed."""
    make = _finder(path, min_length, max_ratio, known_digests)
    _run.text_batches(docs)

    def masked(texts: pa.Array) -> pa.Array:
        look = make()
        _run.give_back()
        out = []
        for text in texts.to_pylist():
            for start, length, *_ in reversed(look(text)):
                text = text[:start] + MASK + text[start + length :]
            out.append(text)
        return pa.array(out, pa.string())

    [new] = _run.fresh(docs, "_masked")
    done = docs.withColumn(new, F.arrow_udf(masked, "string").asNondeterministic()("text"))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(new) != F.col("text"), F.length(new).cast(kind)).otherwise(F.col("n_chars"))
    return done.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", F.explode("secrets").alias("s"))
    return found.select("doc_id", "s.start", "s.length", "s.tokens", "s.ratio")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets masked."""
    return redact(docs)
