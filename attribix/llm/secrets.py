"""Secret scans: three base patterns, and strings that a primed zstandard compressor cannot explain.

A candidate is a long string without white space that begins at most ``REACH`` characters behind a sensitive word on its
line, or on the next line where the word's line ends in a colon or an equals sign. The compressor is primed
with a dictionary of common identifiers and with the text around the candidate, without the candidate itself. What the
candidate adds to the compressed size of its lead is its novelty: names, paths and repeated values cost few bytes, keys
and passwords nearly one byte a character. Candidates that add at least ``NOVELTY`` bytes a character are reported; strings
of letters alone, and passwords with punctuation, have bars of their own, as words of prose look most like these. Runs of
16 digits or more are hex spans already. Long
ones, of more than ``WHOLE``, are compressed in pieces of at most ``PIECE`` characters, each primed with those before it: in longer runs entropy
coding makes even random strings of few symbols cheap. The lines of a private key block are judged as one string; a block
without its end runs to its last key-like line. The time is linear in the text, whatever it holds.

Defined results: a null or empty text has no spans. Repeated rows and null doc_ids come out as they went in. Matches of
one kind never overlap; spans of different kinds may. An empty table gives an empty result. Further columns are not
read by :func:`found` and not touched by :func:`redacted`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import takes_over

# Kinds in the order in which they are listed at one start, and the patterns and lengths of the base kinds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Words that make what follows them sensitive.
SENSITIVE = (
    b"access", b"apikey", b"api_key", b"auth", b"bearer", b"client_id", b"cookie", b"credential", b"encryption",
    b"passphrase", b"passwd", b"password", b"private", b"pwd", b"secret", b"session", b"signature", b"signing", b"token",
)
#: Those that a password with punctuation may follow.
PASSWORDS = frozenset(("credential", "passphrase", "passwd", "password", "pwd", "secret"))
_LEAD = re.compile("|".join(w.decode() for w in SENSITIVE), re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_=~.-]+")
#: Passwords with punctuation; each must hold a small and a capital letter, a digit and one of the marks.
_PASSWORD = re.compile(r"[A-Za-z0-9!@#$%^&*?+=_~-]+")
_MARKED = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])(?=.*[!@#$%^&*?])")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----", re.ASCII)
#: Lines of a block, also with line ends written as escapes.
_BLOCK_LINE = re.compile(r"(?:(?<=\s)|(?<=\\[nr]))[A-Za-z0-9+/=]+(?=\s|\\[nr])")
#: A line of a block that has no end: long, or the padded rest of a key.
_OPEN_LINE = re.compile(r"(?:\s|\\[nr])+(?:[A-Za-z-]+: [^\n\\]*(?:\s|\\[nr])+)*([A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]+={1,2})(?=\s|\\[nr]|$)")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")

#: Characters between the sensitive word and the candidate at most; characters of surrounding text on each side.
REACH = 128
AROUND = 1024
#: Least length and least novelty of strings with letters and digits, of letters alone, and of passwords with punctuation.
LENGTH, NOVELTY = 16, 0.7
LETTERS_LENGTH, LETTERS_NOVELTY = 24, 0.85
PASSWORD_LENGTH, PASSWORD_NOVELTY = 12, 0.8
#: Share of vowels above which letters of one case may be a word.
VOWELS = 0.23
WHOLE, PIECE = 64, 48

IDENTIFIERS = b"""
access account address algorithm alias android application arguments array assert async attribute author authorization
await backend basename boolean browser buffer build bytes cache callback certificate channel charset checksum class
client cluster column command comment commit config configuration connection const constant container content context
cookie count create credentials current database dataset date debug default define delete dependency description device
directory document domain double dropdown element email enabled encoding endpoint environment error event example
exception execute export extends false field file filename filter final float folder format framework from function
generate getattr github global group handler hash header height host html http https icon identifier image implements
import include index info initialize input insert instance integer interface internal item javascript json key keyword
label lambda language layout length library license link list listener local localhost location lock logger login long
main manager margin mask master match message metadata method migration model module name namespace network null number
object offset operator option order output override package padding page parameter parent parse password path pattern
payload permission pipeline plugin pointer policy port position prefix primary print private process product profile
project property protected protocol provider proxy public python query queue random range read record redirect
reference region register release remote render replace repository request required reset resource response result
return role root route runtime schema scope script search secret section select self server service session setting
shared signature size sort source stage start state static status storage stream string struct style submit success
suffix summary switch symbol sync system table target task template temporary test text thread time timeout timestamp
title token tracking transaction transform translate true tuple type undefined unique update upload url user username
utf valid value variable vector version view virtual void width window worker workspace wrapper write www xml yaml
"""


def novelty(text: str, start: int, end: int) -> float:
    """Bytes the candidate adds to its lead, a character, to a compressor primed with identifiers and the text around."""
    value = text[start:end]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    primer = IDENTIFIERS + (after + "\n" + before).replace(value, "").encode()
    pieces = 1 if len(value) <= WHOLE else -(-len(value) // PIECE)
    cuts = [len(value) * i // pieces for i in range(pieces + 1)]
    lead, added = before[-16:].encode(), 0
    for lo, hi in zip(cuts, cuts[1:]):
        known = primer + value[max(0, lo - AROUND) : lo].encode()
        packer = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False, write_checksum=False, write_dict_id=False)
        added += len(packer.compress(lead + value[lo:hi].encode())) - len(packer.compress(lead))
    return added / len(value)


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by the order of kinds."""
    if not text:
        return []
    low = text.encode().lower()
    out = []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if b"akia" in low:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(w in low for w in SENSITIVE):
        out += _novel(text, out)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class _Taken:
    """Spans already reported, merged, to be asked in the order of the text or not."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def _novel(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Lines of key blocks, and candidates of each sensitive word; none that touches a base span."""
    found = _Taken((s, e) for _, s, e in base)
    block = [(s, e) for s, e in _key_blocks(text) if not found.touches(s, e)]
    yield from (("novel", s, e) for s, e in block)
    found = _Taken([*zip(found.starts, found.ends), *block])
    done, stop = 0, -1
    for word in _LEAD.finditer(text):
        end = word.end()
        if end > stop:
            stop = _line_end(text, end)
            over = text[max(0, stop - 4) : stop].rstrip()[-1:] in (":", "=")
        parts = [(end, min(stop, end + REACH), stop)]
        if over and stop - end <= REACH and stop < len(text):
            after = _line_end(text, stop + 1)
            parts.append((stop + 1, min(after, stop + 1 + REACH), after))
        for low, high, last in parts:
            at = max(low, done)
            while at <= high and (run := _CLASS.search(text, at, min(last, high + 1))):
                start = run.start()
                at, value = _judged(text, start, last, word[0].lower() in PASSWORDS)
                done = max(done, at)
                if value and not found.touches(*value):
                    yield "novel", *value


_CLASS = re.compile(r"[A-Za-z0-9+/_=~.!@#$%^&*?-]")


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _judged(text: str, start: int, last: int, password: bool) -> tuple[int, tuple[int, int] | None]:
    """Where the string that begins here ends, and its span if it is novel enough."""
    plain = _RUN.match(text, start, last)
    marked = _PASSWORD.match(text, start, last)
    end = max(m.end() for m in (plain, marked) if m)
    if password and marked and (plain is None or marked.end() > plain.end()) and marked.end() - start >= PASSWORD_LENGTH:
        value = marked[0].rstrip("!?")
        if len(value) >= PASSWORD_LENGTH and _MARKED.match(value):
            return end, (start, start + len(value)) if novelty(text, start, start + len(value)) >= PASSWORD_NOVELTY else None
    if plain is None or plain.end() - start < LENGTH or not _LETTER.search(plain[0]):
        return max(start + 1, plain.end() if plain else end), None
    least = NOVELTY
    if not _DIGIT.search(plain[0]):
        if plain.end() - start < LETTERS_LENGTH or not plain[0].isalpha() or _like_a_word(plain[0]):
            return plain.end(), None
        least = LETTERS_NOVELTY
    return plain.end(), plain.span() if novelty(text, *plain.span()) >= least else None


def _like_a_word(letters: str) -> bool:
    """Long words and names are new to any dictionary; they change their case seldom and have a vowel in four letters or so."""
    changes = sum(a.islower() != b.islower() for a, b in zip(letters, letters[1:]))
    return changes * 5 < 2 * len(letters) and sum(map(letters.lower().count, "aeiou")) > VOWELS * len(letters)


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the lines of private key blocks that hold a novel string."""
    heads = [m.span() for m in _BLOCK.finditer(text)]
    closed = text.find("-----END", heads[0][1]) if heads else -1
    for k, (_, at) in enumerate(heads):
        if -1 < closed < at:
            closed = text.find("-----END", at)
        upto = heads[k + 1][0] if k + 1 < len(heads) else len(text)
        if -1 < closed <= upto:
            lines = [m.span() for m in _BLOCK_LINE.finditer(text, at, closed)]
        else:
            lines = []
            while m := _OPEN_LINE.match(text, at, upto):
                lines.append(m.span(1))
                at = m.end()
        if not lines:
            continue
        value = "".join([text[s:e] for s, e in lines])
        lead = text[max(0, lines[0][0] - AROUND) : lines[0][0]]
        around = lead + value + text[lines[-1][1] : lines[-1][1] + AROUND]
        if len(value) >= LENGTH and novelty(around, len(lead), len(lead) + len(value)) >= NOVELTY:
            yield from lines


SPANS = "array<struct<kind:string,start:int,end:int>>"


def found(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("secrets", lambda: None)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: str | None) -> str | None:
    """The text with each secret, or run of overlapping ones, replaced by ``[kind]`` of the first."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and ``n_chars``, where it exists, counted anew for masked rows."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        takes_over("secrets", lambda: None)
        return pa.array([mask(t.as_py()) for t in texts], pa.string())

    columns = docs.columns
    out = docs.withColumn("text", masked.asNondeterministic()(F.col("text").cast("string")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
