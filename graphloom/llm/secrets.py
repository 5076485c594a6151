"""Secret scan by dictionary-primed zstandard novelty.

A candidate is a run of 16 or more key-like characters in sensitive context: a
word such as token or password on its line, however far, on the line before if that
ends in an assignment, or in the key of a block that it is indented under; or a known
key prefix.  A quoted value of 8 or more characters without white space right after
such a word is one too, whatever it is made of, and so is the body of a PEM private
key, as a whole.  Quoted values under 16 characters must hold more than letters, as
a word can't be told from a password of letters.  A candidate's
novelty is what it costs to compress once a compressor knows the code around it
(CONTEXT_CHARS on either side, the candidate itself taken out) and a dictionary of identifiers: the marginal
compressed bytes over those of a random string of its alphabet and length.  Words,
identifiers, placeholders and repeats cost little; random strings cost as much as
others of their kind, whatever their length, and are reported.

Defined results: null and empty texts have no findings, an empty table gives an empty
result; very long texts are scanned whole, only the code that primes the compressor is a
window; the same string is found at each place it occurs, of overlapping candidates (ties)
the one that begins first; repeated rows report alike; findings carry a hash and a mask,
never the string; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CHARS = 16
LEAST_QUOTED = 8
CONTEXT_CHARS = 2048  # of surrounding code on either side that prime the compressor
NOVELTY = 0.8

KEYWORDS = r"(?i)(?:tokens?|secrets?|passw(?:or)?d|passphrase|pwd|api[_-]?keys?|access[_-]?keys?|private[_-]?keys?|auth(?:orization)?|credentials?|bearer|signature)"
PREFIXES = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|pk_live_|sk_live_|xox[abprs]-|AIza|eyJ[A-Za-z0-9])"
PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_candidate = re.compile(r"[A-Za-z0-9+/_\-=~.]{%d,}" % LEAST_CHARS)
_keyword = re.compile(KEYWORDS)
_prefix = re.compile(PREFIXES)
#: Its headers are no part of a key; its body may be split into string literals or hold escaped line ends.
_pem = re.compile(PEM + r"""(?:[ \t]*\r?\n(?:[A-Za-z-]+: [^\n]*\n(?:[ \t][^\n]*\n)*)+)?((?:[A-Za-z0-9+/=\s"'`,;>|#*\\]|-(?!----))*)""")
_escape = re.compile(r"\\[nrt]|[^A-Za-z0-9+/=]")
#: A keyword (no author), the rest of its key, a separator, perhaps a type, and the quoted value.
_quoted = re.compile(KEYWORDS + r"""(?!or)(?=[\w.\-]{0,64}(?:\\?["'`])?\]?\s*(?:[:=]{1,3}>?|,|\()\s*(?:[\w.\[\]]{1,64}\s*=\s*)?[bru]?(\\?["'`])((?:(?!\1)(?:\\\S|[^\s\\]))+)\1)""")
_no_value = re.compile(r"[$%#]?\{.*\}|<.*>|\[.*\]|%\(.*\)s?|%\w+%|\$[A-Z_]+|\w+://[^@]*|\d{1,4}(?:[-./:]\d+)+")
_opens = re.compile(r"""([\w.$-]+)["'`\]]*\s*(?::|:?=|=>)\s*(?:[|>][+-]?|[\\\[{("'`])*\s*$""")
_defines = re.compile(r"\s*(?:class|def|interface|struct|enum|trait|impl|if|elif|for|while|with|case)\b")

IDENTIFIERS = (
    "true false null none undefined function return import from class public private static void string number boolean object array value values key keys name names "
    "index count length size type types id ids user users username email password passwd secret secrets token tokens access refresh api apikey api_key client client_id client_secret "
    "config configuration settings options params arguments request response header headers authorization bearer basic session cookie host port path url uri http https www com org net "
    "example example.com localhost 127.0.0.1 default placeholder changeme your_token_here your-api-key insert_here replace_me dummy sample test testing development production staging "
    "environment variable process.env os.environ getenv System.getenv ENV export const let var def self this new database connection timeout retry service server account project region "
    "bucket queue topic table column select insert update delete where order group limit create drop alter index primary foreign utf-8 base64 sha256 md5 hmac encode decode encrypt decrypt "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxx 1234567890 ...................."
).encode()


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that candidate adds, given the text around it and the identifier dictionary."""
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around.replace(candidate, " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=9, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False).compress
    return len(compress(candidate.encode())) - len(compress(b""))


#: Alphabets of keys, the narrowest first. Letters of one case alone count as if digits were among them: words are such letters.
ALPHABETS = tuple((re.compile(f"[{c}]+"), n) for c, n in (("0-9", 10), ("0-9a-f", 16), ("0-9A-F", 16), ("0-9A-Z", 36), ("0-9a-z", 36), ("0-9A-Za-z+/_=-", 64), ("!-~", 94)))
_LONG = 4096  # a random string's cost a character no longer changes


@lru_cache(maxsize=1 << 14)
def _random_bytes(letters: int, n: int) -> float:
    """Marginal bytes of a random string of n characters out of so many, at most n."""
    chars = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/!\"#$%&'()*,-.:;<=>?@[\\]^_`{|}~"[:letters]
    drawn = hashlib.shake_256(f"{letters} {n}".encode()).digest(2 * n)
    return min(n, marginal_bytes("".join(chars[(drawn[i] << 8 | drawn[i + 1]) % letters] for i in range(0, 2 * n, 2)), ""))


def random_bytes(candidate: str) -> float:
    """What a random string over the candidate's alphabet and of its length costs."""
    n, letters = len(candidate), next((k for e, k in ALPHABETS if e.fullmatch(candidate)), 256)
    if letters == 256:
        return n
    return _random_bytes(letters, n) if n <= _LONG else _random_bytes(letters, _LONG) * n / _LONG


def _private_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, key) of the body of each PEM private key."""
    for m in _pem.finditer(text):
        start, end = m.span(1)
        while start < end and (e := _escape.match(text, start, end)):
            start = e.end()
        while end > start and (not (text[end - 1].isalnum() or text[end - 1] in "+/=") or (text[end - 1] in "nrt" and text[end - 2] == "\\")):
            end -= 1
        parts = _escape.sub(" ", text[start:end]).split()
        key = "".join(parts)
        if len(key) >= LEAST_CHARS and 2 * sum(len(p) for p in parts if len(p) >= LEAST_CHARS) >= len(key):
            yield start, end, key


def _quoted_values(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, keyword) of each quoted value after a keyword."""
    for m in _quoted.finditer(text):
        value = m.group(2)
        word = all(c.isalpha() or c in "_-./:" for c in value)
        if len(value) >= LEAST_QUOTED and not (len(value) < LEAST_CHARS and (word or value.lower().encode() in _known)) and len(set(value)) > 3 and not _no_value.fullmatch(value):
            yield *m.span(2), m.group().lower()


_known = set(IDENTIFIERS.split())


class _Context:
    """Keywords around the candidates of a text; lines and blocks are looked at as they are needed."""

    def __init__(self, text: str):
        self.text, self.on_line, self.above = text, {}, None

    def at(self, start: int, end: int) -> str | None:
        lo, hi = self.text.rfind("\n", 0, start) + 1, self.text.find("\n", end)
        if lo not in self.on_line:
            words = [(m.start(), m.end(), m.group()) for m in _keyword.finditer(self.text, lo, hi if hi >= 0 else len(self.text))]
            self.on_line[lo] = [w[0] for w in words], words
        begins, words = self.on_line[lo]
        i = bisect_left(begins, start)
        while i and words[i - 1][1] > start:  # half in the candidate
            i -= 1
        if i:
            return words[i - 1][2].lower()
        i = bisect_left(begins, end)
        return words[i][2].lower() if i < len(words) else self._block(lo)

    def _block(self, line: int) -> str | None:
        """The keyword of the line before, if it ends in an assignment, or of the key of an enclosing block."""
        if self.above is None:
            self.above, before, stack, at = {}, None, [], 0
            for x in self.text.split("\n"):
                if x.strip():
                    indent = len(x) - len(x.lstrip())
                    while stack and stack[-1][0] >= indent:
                        stack.pop()
                    outer = stack[-1][1] if stack else None
                    self.above[at] = before or outer
                    defines = _defines.match(x)
                    opens = None if defines else _opens.search(x[-200:])
                    own = _keyword.search(opens.group(1)) if opens else None
                    last = list(_keyword.finditer(x)) if opens else []
                    before = last[-1].group().lower() if last else None
                    stack.append((indent, own.group().lower() if own else None if defines else outer))
                at += len(x) + 1
        return self.above.get(line)


def scan_text(text: str, novelty: float = NOVELTY) -> list[tuple[int, int, str, int, float, str, str]]:
    """(start, length, context, marginal bytes, novelty, sha256, mask) of each finding."""
    found, taken, keyed = [], [], {}

    def judge(start: int, end: int, value: str, context: str) -> bool:
        around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        extra, usual = marginal_bytes(value, around), random_bytes(value)
        if extra < novelty * usual:
            return False
        found.append((start, end - start, context, extra, round(extra / usual, 4), hashlib.sha256(value.encode()).hexdigest(), value[:2] + "***" + value[-2:]))
        return True

    for start, end, value in _private_keys(text):
        taken.append((start, end))
        judge(start, end, value, "private key")
    keys = len(taken)
    for start, end, word in _quoted_values(text):
        i = bisect_left(taken, (start,), hi=keys)
        if (i and taken[i - 1][1] > start) or start in keyed:
            continue
        keyed[start] = word
        if not _candidate.fullmatch(text, start, end) and judge(start, end, text[start:end], word):
            taken.append((start, end))
    taken.sort()
    context = _Context(text)
    for m in _candidate.finditer(text):
        value = m.group().strip("=.~-/+_") if "=" in m.group()[:-2] else m.group().rstrip(".")
        start = m.start() + m.group().find(value)
        if "=" in value[:-2]:  # an assignment without spaces: name=value
            name, _, rest = value.rpartition("=")
            start, value = start + len(name) + 1, rest
        if len(value) < LEAST_CHARS:
            continue
        i = bisect_left(taken, (start + len(value),))
        if i and taken[i - 1][1] > start:  # part of a finding, or of a key that is none
            continue
        word, prefix = keyed.get(m.start()) or context.at(start, start + len(value)), _prefix.match(value)
        if word or prefix:
            judge(start, start + len(value), value, word or "prefix:" + prefix.group())
    return sorted(found)


def secret_findings(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """A row for each finding: doc_id, start and length (characters), context, marginal_bytes, novelty, sha256, mask."""
    # only texts with some context leave the JVM; scan_text looks for the same
    maybe = docs.where(F.col("text").rlike(KEYWORDS) | F.col("text").rlike(PREFIXES) | F.col("text").rlike(PEM)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "start", "length", "context", "marginal_bytes", "novelty", "sha256", "mask"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string()]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in scan_text(t, novelty)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return maybe.mapInArrow(make, "doc_id long, start long, length long, context string, marginal_bytes long, novelty double, sha256 string, mask string")
