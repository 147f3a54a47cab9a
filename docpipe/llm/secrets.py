"""Secrets in texts, by one combined automaton over all rules."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.automaton import Scanner
from docpipe.llm.shared import once, share, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``scan`` is what the automaton looks for. A match, or
    the group of ``value`` in it, must have ``least`` characters; a match that
    fails is dropped but still taken, so nothing inside it matches. Lengths
    stand there rather than in ``scan`` where a rule can start anew inside its
    own run: counting those runs would square the automaton. ``tail`` gives the
    end of what follows a match and belongs to it, from the text's bytes, the
    match's end and a dict that one text's matches share."""

    kind: str
    scan: str
    ignore_case: bool = False
    value: str | None = None
    least: int = 0
    tail: Callable[[bytes, int, dict], int] | None = None


_KEYWORDS = "(password|passwd|secret|token|api_?key)"
_RUN = "[A-Za-z0-9+/_.=-]+"
_EITHER_CASE = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", _KEYWORDS)

_HEADER = re.compile(rb"[A-Za-z0-9-]+: [^\r\n]*")
_SPACES, _BREAKS, _INDENT = re.compile(rb"\s*"), re.compile(rb"[\r\n]*"), re.compile(rb"[ \t]*")
_LINES, _BODY = re.compile(rb"[A-Za-z0-9+/=\s\\]*"), re.compile(rb"[A-Za-z0-9+/=\r\n\\]*")
_END = re.compile(rb"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")


def _header_and_breaks(data: bytes, at: int) -> int | None:
    header = _HEADER.match(data, _SPACES.match(data, at).end())
    end = _BREAKS.match(data, header.end()).end() if header else at
    return end if header and end > header.end() else None


def _breaks_and_header(data: bytes, at: int) -> int | None:
    start = _BREAKS.match(data, at).end()
    header = _HEADER.match(data, start) if start > at else None
    return header.end() if header else None


def _closed(data: bytes, at: int) -> int | None:
    closing = _END.match(data, _LINES.match(data, at).end())
    return closing.end() if closing else None


def _open(data: bytes, at: int) -> int:
    line = _BREAKS.match(data, at).end()
    return _BODY.match(data, _INDENT.match(data, line).end() if line > at else at).end()


def _key_end(data: bytes, at: int, step: Callable, body: Callable, known: dict) -> int | None:
    """What ``body`` gives behind as many ``step`` as there are. Places that
    were passed before are known, so a text full of keys is read once."""
    passed = []
    while at not in known:
        passed.append(at)
        after = step(data, at)
        if after is None:
            known[at] = body(data, at)
        else:
            at = after
    known.update(dict.fromkeys(passed, known[at]))
    return known[at]


def key_body(data: bytes, end: int, known: dict) -> int:
    """The end of a private key whose BEGIN line ends at ``end``: header lines
    (``Name: value``) and base64 lines, with line ends that may be escaped or
    indented, up to the END line; without one, the base64 that follows. Each
    pattern reads a run that the next can't start in, so nothing is tried twice."""
    closed = _key_end(data, end, _header_and_breaks, _closed, known.setdefault("closed", {}))
    return _key_end(data, end, _breaks_and_header, _open, known.setdefault("open", {})) if closed is None else closed


#: The three base kinds and their lengths.
BASE = (
    Rule("assign", rf"""{_EITHER_CASE}["']?\x20*[:=]\x20*["']?{_RUN}""", value=rf"""["']?\x20*[:=]\x20*["']?({_RUN})\Z""", least=12),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Published formats of further credentials.
MORE = (
    Rule("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", tail=key_body),
    Rule("forge_token", "(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", least=40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=36),
)
RULES = BASE + MORE

class SecretFinder:
    """The combined automaton of some rules, compiled once."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.scanner = Scanner([(r.scan, r.ignore_case) for r in rules])
        self.values = [re.compile(r.value.encode()) if r.value else None for r in rules]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then rule order."""
        if not text:
            return []
        data, rules = text.encode("utf-8", "surrogatepass"), self.rules
        out, known = [], {}
        for rule, start, end in self.scanner.spans(data):
            match = self.values[rule].search(data[start:end]) if self.values[rule] else None
            if (len(match[1]) if match else end - start) >= rules[rule].least:
                if rules[rule].tail:
                    end = rules[rule].tail(data, end, known)
                out.append((start, rule, end))
        if len(data) != len(text):
            out = [(len(data[:s].decode("utf-8", "surrogatepass")), r, len(data[:e].decode("utf-8", "surrogatepass"))) for s, r, e in out]
        return [(rules[r].kind, s, e) for s, r, e in sorted(out)]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id, spans
    (array of kind, start, end in code points, by start and then rule order).

    Null and empty texts have no spans; repeated rows stay. No shuffle."""
    held = share(docs.sparkSession, SecretFinder(rules))

    def work(batches):
        finder = once(held)
        for batch in slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in finder.find(t)] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in brackets;
    overlapping spans become one mark, of the first kind. All columns and rows
    stay; ``n_chars``, if there, is the new length of a changed text."""
    columns, held = docs.columns, share(docs.sparkSession, SecretFinder(rules))

    def clean(finder: SecretFinder, text: str | None) -> str | None:
        spans = finder.find(text)
        if not spans:
            return text
        out, at = [], 0
        for kind, start, end in spans:
            if start >= at:
                out += [text[at:start], mark.format(kind=kind)]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def work(batches):
        finder = once(held)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            new = [clean(finder, t) for t in texts]
            arrays = []
            for name in columns:
                column = batch.column(name)
                if name == "text":
                    column = pa.array(new, column.type)
                elif name == "n_chars":
                    column = pa.array([n if a == b else len(b) for n, a, b in zip(column.to_pylist(), texts, new)], column.type)
                arrays.append(column)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(work, docs.schema)


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) of
    ``scan_secrets``: base spans as kind:start:end, joined by commas, hashed."""
    base = [r.kind for r in BASE]
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    found = scan_secrets(docs, rules)

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    kept = F.filter("spans", lambda x: x.kind.isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def checksum(spans: list[tuple[str, int, int]]) -> str:
    """The digest of ``secret_digest`` for one text's base spans."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
