"""Secret scans with multipart credential linking.

Candidates are access identifiers, secrets and endpoints. A strong one shows by its form what it is (a provider's
prefix, a private key header, a named value with the entropy of a random string) and is always reported. A weak one (a
named short value, a bare random string, a plain address) is reported only if a candidate of a complementary kind
stands in its scope: the two lie in one text with at most SCOPE bytes between them. The scopes are joined as intervals: candidates of a
batch are sorted by row and place, and each one's interval is looked up by binary search in every other kind's places.

Offsets are in bytes of the UTF-8 text. Where candidates overlap, the first pattern of PATTERNS wins; within one pattern
they don't overlap. Nearest partners are linked; of equally near ones the first. Values have no upper length: they run to the end
of their class of characters, and a private key to its footer.

Defined results. Null and empty texts have nothing. Scopes never cross rows, so rows without doc_id and repeated rows are
scanned each by itself. Long texts take time in proportion to their length and candidates. An empty table gives an empty
result. scanned() doesn't read other columns; redacted() passes them through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tramline.llm.shared import returning, rewritten, texts
from tramline.llm.textnum import buffers, pieces

SCOPE, ENTROPY = 200, 3.0
ID, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
KINDS = (ID, SECRET, ENDPOINT)
_NAMED = r"(?:secret|token|password|passwd|pwd|api_?key|apikey|access_?key|auth|credential)"
_USER = r"(?:client_?id|access_?key_?id|account|user_?name|user|login|tenant_?id)"
_SET = r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
#: (rule, kind, strong, literal that must occur in the lower-cased text for the pattern to match or None, pattern). The value is group 1
#: and runs to the end of its class of characters; a private key goes on to its footer, see _keys().
PATTERNS = (
    ("private_key", SECRET, True, "private key", rb"(-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{16,})*)"),
    ("cloud_key_id", ID, True, None, rb"\b((?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16})\b"),
    ("prefixed_token", SECRET, True, None, rb"\b((?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35,}|npm_[A-Za-z0-9]{36,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))"),
    ("credential_url", SECRET, True, "://", rb"(\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]+@[^\s\"'<>]+)"),
    ("named_secret", SECRET, False, None, (r"(?i)(?:\b|_)" + _NAMED + _SET + r"([A-Za-z0-9+/=_.~!@#$%^&*-]{6,})").encode()),
    ("named_identifier", ID, False, None, (r"(?i)(?:\b|_)" + _USER + _SET + r"([A-Za-z0-9_.@-]{3,})").encode()),
    ("url", ENDPOINT, False, "://", rb"(\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{3,})"),
    ("address", ENDPOINT, False, None, rb"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?)\b"),
    ("random_string", SECRET, False, None, rb"\b([A-Za-z0-9+/_-]{32,}={0,2})"),
)
_COMPILED = [re.compile(p) for *_, p in PATTERNS]
_SCREEN = [p.decode() for *_, p in PATTERNS]
_FOOTER = re.compile(rb"-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")


def entropy(value: bytes) -> float:
    """Bits a byte."""
    n = np.bincount(np.frombuffer(value, np.uint8))
    n = n[n > 0] / len(value)
    return float(-(n * np.log2(n)).sum())


def _keys(pattern: re.Pattern, text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of private keys from header to the next footer, whatever stands between; without a footer, the header and the lines of a key behind it."""
    footer, at = True, 0
    while (m := pattern.search(text, at)) is not None:
        footer = footer and _FOOTER.search(text, m.start(1))
        at = footer.end() if footer else m.end(1)
        yield m.start(1), at


def candidates(column: pa.Array) -> dict[str, np.ndarray]:
    """row, rule, kind, strong, begin and end of all candidates of a batch, sorted by row and place."""
    data, offsets = buffers(column)
    blob = data.tobytes()
    found: list[tuple[np.ndarray, ...]] = []
    # Spans taken so far, which don't overlap, as sorted first and last places in the batch.
    taken = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lowered = None
    for rule, ((name, _, strong, literal, _), pattern, screen) in enumerate(zip(PATTERNS, _COMPILED, _SCREEN, strict=True)):
        if literal is not None:
            if lowered is None:
                lowered = pc.utf8_lower(column)
            hit = pc.match_substring(lowered, literal)
        else:
            hit = pc.match_substring_regex(column, screen)
        spans = []
        for row in np.flatnonzero(np.asarray(pc.fill_null(hit, False))).tolist():
            base = int(offsets[row])
            # A text of its own, since word boundaries look at what stands before the place where a search begins.
            own = blob[base : int(offsets[row + 1])]
            for begin, end in _keys(pattern, own) if name == "private_key" else (m.span(1) for m in pattern.finditer(own)):
                value, sure = own[begin:end], strong
                if name == "named_secret":
                    sure = len(value) >= 16 and entropy(value) >= ENTROPY and any(48 <= c < 58 for c in value)
                elif name == "random_string" and (entropy(value) < ENTROPY or not any(48 <= c < 58 for c in value)):
                    continue
                elif name == "address" and any(int(x) > 255 for x in value.split(b":")[0].split(b".")):
                    continue
                spans.append((row, base + begin, base + end, sure))
        if not spans:
            continue
        row, begin, end, sure = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        before = np.searchsorted(taken[0], end, "left") - 1
        free = (before < 0) | (taken[1][np.maximum(before, 0)] <= begin) if len(taken[0]) else np.ones(len(begin), bool)
        row, begin, end, sure = row[free], begin[free], end[free], sure[free]
        found.append((row, begin - offsets[row], end - offsets[row], np.full(len(row), rule), sure))
        order = np.argsort(np.concatenate([taken[0], begin]), kind="stable")
        taken = np.concatenate([taken[0], begin])[order], np.concatenate([taken[1], end])[order]
    row, begin, end, rule, strong = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5))
    order = np.lexsort((begin, row))
    row, begin, end, rule, strong = row[order], begin[order], end[order], rule[order], strong[order]
    kind = np.array([KINDS.index(p[1]) for p in PATTERNS])[rule] if len(rule) else rule
    return {"row": row, "begin": begin, "end": end, "rule": rule, "kind": kind, "strong": strong.astype(bool)}


def links(c: dict[str, np.ndarray], scope: int = SCOPE) -> np.ndarray:
    """partner[i, kind]: the nearest candidate of that kind in candidate i's scope, or -1; -1 for its own kind."""
    n = len(c["row"])
    partner = np.full((n, len(KINDS)), -1, np.int64)
    if not n:
        return partner
    # Rows lie far apart on one line, so an interval never reaches another row.
    wide = int(c["end"].max()) + 2 * scope + 2
    begin, end = c["row"] * wide + c["begin"], c["row"] * wide + c["end"]
    for k in range(len(KINDS)):
        own = np.flatnonzero(c["kind"] == k)
        if not len(own):
            continue
        ask = np.flatnonzero(c["kind"] != k)
        after = np.searchsorted(begin[own], end[ask], "left")
        before = np.searchsorted(end[own], begin[ask], "right") - 1
        far = np.int64(1) << 60
        right = np.where(after < len(own), begin[own[np.minimum(after, len(own) - 1)]] - end[ask], far)
        left = np.where(before >= 0, begin[ask] - end[own[np.maximum(before, 0)]], far)
        best = np.where(left <= right, own[np.maximum(before, 0)], own[np.minimum(after, len(own) - 1)])
        partner[ask, k] = np.where(np.minimum(left, right) <= scope, best, -1)
    return partner


def reported(c: dict[str, np.ndarray], partner: np.ndarray) -> np.ndarray:
    """Strong ones, and weak ones with a complement: a secret needs an identifier or endpoint, the others need a secret."""
    secret = KINDS.index(SECRET)
    complement = np.where(c["kind"] == secret, (partner >= 0).any(axis=1), partner[:, secret] >= 0)
    return c["strong"] | complement


def scanned(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, begin, end, kind, rule, strong, identifier_at, secret_at, endpoint_at): what is reported, and where the
    linked parts begin (null where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                c = candidates(part.column("text"))
                partner = links(c, scope)
                show = np.flatnonzero(reported(c, partner))
                if not len(show):
                    continue
                at = partner[show]
                places = [pa.array(c["begin"][np.maximum(at[:, k], 0)], mask=at[:, k] < 0) for k in range(len(KINDS))]
                names = [pa.array(values).take(pa.array(c[key][show])) for key, values in (("kind", list(KINDS)), ("rule", [p[0] for p in PATTERNS]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(c["row"][show])), pa.array(c["begin"][show]), pa.array(c["end"][show]), *names, pa.array(c["strong"][show]), *places], ["doc_id", "begin", "end", "kind", "rule", "strong", "identifier_at", "secret_at", "endpoint_at"])

    return texts(docs).mapInArrow(returning(run), "doc_id long, begin long, end long, kind string, rule string, strong boolean, identifier_at long, secret_at long, endpoint_at long")


def redacted(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with what scanned() reports replaced by mark in text; n_chars, where it is an integer, follows the new text. All other
    columns stay as they are, whatever their names; a null text stays null."""
    text_at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    numeric = size_at is not None and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, f"c{text_at}"):
                column = part.column(text_at)
                c = candidates(column)
                show = np.flatnonzero(reported(c, links(c, scope)))
                if len(show):
                    values = column.to_pylist()
                    cuts: dict[int, list[tuple[int, int]]] = {}
                    for i in show.tolist():
                        cuts.setdefault(int(c["row"][i]), []).append((int(c["begin"][i]), int(c["end"][i])))
                    for row, own in cuts.items():
                        raw, out, last = values[row].encode(), [], 0
                        for begin, end in own:
                            out += [raw[last:begin], mark.encode()]
                            last = end
                        values[row] = b"".join([*out, raw[last:]]).decode()
                    part = part.set_column(text_at, part.schema.field(text_at), pa.array(values, column.type))
                    if numeric:
                        old, touched = part.column(size_at), np.zeros(len(values), bool)
                        touched[list(cuts)] = True
                        part = part.set_column(size_at, part.schema.field(size_at), pc.if_else(pa.array(touched), pc.utf8_length(part.column(text_at)).cast(old.type), old))
                yield part

    return rewritten(docs, run)
