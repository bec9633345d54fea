"""Secret scans: given shapes of secrets, and random strings that a tokenizer's vocabulary finds hard to write.

Three shapes are fixed (assignments to a word such as `password`, access keys, runs of hexadecimal digits); their matches are
leftmost and non-overlapping within a kind, and those that are too short are dropped afterwards, so they use up their letters.
The method adds strings by token efficiency: words and names are written with many characters a token, random strings with few.
A candidate is a run of `MIN_LENGTH` letters, digits and + / _ = - that no given match overlaps; it is a secret if it has at
most `MAX_RATIO` characters a token under a byte-pair vocabulary. Left out before that are known digests (hexadecimal strings
of the lengths that hash functions give, and UUIDs: checksums and commit names are public) and identifiers (numbers, words,
and names made of words in any usual case: snake_case, kebab-case, camelCase, paths, with numbers at a word's end).

Figures behind the defaults, 2,000 draws each: of random base64 strings of 16 characters 99 in 100 have at most 1.8 characters
a token, of 40 at most 1.6; mixed capitals and digits 1.8 and 1.7; ordinary words of 16 letters and more have 2 to 4.

Very long runs are tokenized in pieces of `PIECE` characters, so time is proportional to the text. The vocabulary (a file in
tiktoken's format, its path a parameter) is read by the driver, checked against `MAX_VOCABULARY` bytes and broadcast.

Offsets are code points from 0, ends exclusive. Nulls: a null text is empty. Repeated rows give equal rows; a null id stays
null. Empty tables give no rows. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY = 16_000_000
MIN_LENGTH, MAX_RATIO, PIECE = 16, 1.85, 512
KINDS = ("assign", "access", "hex", "random")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The contract's shapes and least lengths (of the value, or of the whole).
_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
_ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
SHAPES = ((_ASSIGN, 2, 12), (_ACCESS, 0, 18), (_HEX, 0, 16))
#: Any hex match that can pass, found quickly; runs are maximal, so these are the same matches.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512; and UUIDs.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_JOINTS = re.compile(r"[-_/+=]+")
#: A number; a word in one case or capitalised, perhaps numbered; camel case of words of three letters and more.
_NAME = re.compile(r"[0-9]+|[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,}|[A-Z]{2,4}(?=[A-Z][a-z]|$))+[0-9]{0,4}")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def known_digest(string: str) -> bool:
    return bool(len(string) in DIGEST_LENGTHS and _HEXADECIMAL.fullmatch(string) or _UUID.fullmatch(string))


def identifier(string: str) -> bool:
    return all(_NAME.fullmatch(part) for part in _JOINTS.split(string) if part)


def encoder(vocabulary: bytes, pattern: str = PATTERN) -> Callable[[str], int]:
    """How many tokens a string has, under a vocabulary in tiktoken's format."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda s: sum(len(encode(s[i : i + PIECE])) for i in range(0, len(s), PIECE))


def random_spans(text: str, given: list[Span], tokens: Callable[[str], int], max_ratio: float = MAX_RATIO) -> list[Span]:
    """Candidates of few characters a token that overlap no given span (sorted)."""
    found, k, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while k < len(given) and given[k][0] < m.end():
            reach, k = max(reach, given[k][2]), k + 1
        if reach <= m.start() and not known_digest(m[0]) and not identifier(m[0]) and len(m[0]) <= max_ratio * tokens(m[0]):
            found.append((m.start(), 3, m.end()))
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        out = f.read(MAX_VOCABULARY + 1)
    if len(out) > MAX_VOCABULARY:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY} bytes")
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or encoder(shared.value)
            counts: list[list[int]] = [[], [], [], []]
            hashes, spans = [], []
            for value in batch.column(1):
                own = value.as_py() or ""
                base = base_spans(own)
                more = random_spans(own, base, tokens, max_ratio)
                both = sorted(base + more)
                for i, c in enumerate(counts):
                    c.append(sum(x[1] == i for x in both))
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(both))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(look, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")



ship(__name__)
