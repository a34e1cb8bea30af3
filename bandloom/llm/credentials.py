"""Secrets in texts: patterns that stand alone, and credentials whose parts are weak by themselves.

A credential has parts of three roles: an identifier, a secret and an endpoint. Base patterns (assigned secrets, access
keys, long hexadecimal strings) are reported wherever they stand. Weak candidates - names of accounts, random-looking
strings, addresses of services - are everywhere in clean text, so one is reported only where complementary parts stand in
the same scope near it: an identifier needs a secret, a secret needs an identifier or an endpoint, and an endpoint needs
both a secret and an identifier. A scope is a run of lines without a blank line between them.

Parts meet by an interval join without pairs. Places are cut into cells as long as the reach; per cell and role the first
and the last place say whether any part of that role is in reach of a place in this cell or in one beside it, since parts
of one cell always are in reach of each other. A candidate so meets one row, however many parts its scope holds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, forget, in_batches

#: Kinds in the order in which spans of one place are listed, and the role of each.
BASE = {"assign": "secret", "access": "identifier", "hex": "secret"}
ADDED = {"endpoint": "endpoint", "identity": "identifier", "random": "secret"}
KINDS = (*BASE, *ADDED)
ROLES = ("identifier", "secret", "endpoint")

#: Fixed patterns of the base kinds. A longest run of characters is what the plain pattern finds first and without overlap.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGNED = 6

#: Weak candidates. An endpoint's user and password, where it names them, are parts of their own.
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://(?:(?P<user>[^\s/:@\"']{1,128}):(?P<word>[^\s/@\"']{1,128})@)?(?P<host>[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+(?::[0-9]{1,5})?)")
IDENTITY = re.compile(r"""(?<![A-Za-z0-9])(?:user_?name|user|login|account(?:_?(?:name|id))?|(?:client|tenant|access|key)_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9@+/_.-]{3,})""", re.IGNORECASE | re.ASCII)
#: Identifiers of short-lived or assigned keys of the same form as base access keys.
OTHER_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,256}={0,2}(?![A-Za-z0-9+/_=-])")
#: Least bits a character of a random-looking string.
ENTROPY = 3.5
#: Code points between the beginnings of parts that belong together.
REACH = 256
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

_PART = pa.struct([("kind", pa.string()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64()), ("value", pa.string())])
_SCANNED = "uid long, doc_id long, base array<struct<kind:string,role:string,start:long,end:long,scope:long,value:string>>, weak array<struct<kind:string,role:string,start:long,end:long,scope:long,value:string>>"


def entropy(s: str) -> float:
    """Bits a character, by the string's own frequencies."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def looks_random(s: str) -> bool:
    """Digits and letters, in both cases unless it is hexadecimal, of high entropy."""
    digits, lower, upper = any(c.isdigit() for c in s), any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s)
    hexadecimal = digits and (lower or upper) and all(c in "0123456789abcdef" for c in s.lower())
    return ((digits and lower and upper) or hexadecimal) and entropy(s) >= (ENTROPY - 0.5 if hexadecimal else ENTROPY)


def base_parts(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of weak candidates, by start. None shares a character with a base part or with another candidate:
    an endpoint goes before an identity, that before a random string, the earlier one before the later."""
    found: list[tuple[str, int, int]] = []
    if "://" in text:
        for m in ENDPOINT.finditer(text):
            found += [("endpoint", *m.span("host"))] + ([("identity", *m.span("user")), ("random", *m.span("word"))] if m["user"] else [])
    found += [("identity", m.start(), m.end()) for m in IDENTITY.finditer(text)]
    found += [("identity", m.start(), m.end()) for m in OTHER_ACCESS.finditer(text)]
    found += [("random", m.start(), m.end()) for m in RANDOM.finditer(text) if looks_random(m.group())]
    taken: list[tuple[int, int]] = []  # disjoint, sorted
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    kept = []
    for kind in ADDED:
        mine: list[tuple[str, int, int]] = []
        for _, a, b in sorted((f for f in found if f[0] == kind), key=lambda f: f[1:]):
            at = bisect_right(taken, (a, math.inf))
            after = at < len(taken) and taken[at][0] < b
            before = (at > 0 and taken[at - 1][1] > a) or (mine and mine[-1][2] > a)
            if not after and not before:
                mine.append((kind, a, b))
        kept += mine
        taken = sorted([*taken, *((a, b) for _, a, b in mine)])
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, doc_id, base, weak = [], [], [], []
        for u, d, text in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            b = base_parts(text)
            w = weak_parts(text, b)
            # Parts of one role alone complete nothing.
            if len({(BASE | ADDED)[k] for k, _, _ in b + w}) < 2:
                w = []
            ends = [m.end() for m in BLANK_LINE.finditer(text)] if w else []
            told = lambda parts: [{"kind": k, "role": (BASE | ADDED)[k], "start": s, "end": e, "scope": bisect_right(ends, s), "value": text[s:e]} for k, s, e in parts]  # noqa: B023, E731
            uid.append(u)
            doc_id.append(d)
            base.append(told(b))
            weak.append(told(w))
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(base, pa.list_(_PART)), pa.array(weak, pa.list_(_PART))], names=["uid", "doc_id", "base", "weak"])


def scan(docs: DataFrame) -> DataFrame:
    """The stored table uid (of a row), doc_id, base, weak: parts with kind, role, start, end (code points, end exclusive),
    scope (number of blank lines before it) and value. Base parts do not depend on ``weak`` ones, nor on the scope."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return durable(in_batches(rows, _scan, _SCANNED))


def complementary(near: dict[str, Column], role: Column) -> Column:
    """Whether a weak candidate of ``role`` is reported, given for each role whether a part of it is in reach."""
    needs = {"identifier": near["secret"], "secret": near["identifier"] | near["endpoint"], "endpoint": near["secret"] & near["identifier"]}
    out = F.lit(False)
    for r, told in needs.items():
        out = F.when(role == r, told).otherwise(out)
    return out


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Those rows of ``parts`` (uid, scope, role, start, weak, ...) that are weak and have their complementary parts in the
    same scope with a start at most ``reach`` away."""
    cell = F.floor(F.col("start") / reach)
    cells = parts.groupBy("uid", "scope", "role", cell.alias("cell")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    # Each cell tells itself and its neighbours what it has.
    told = cells.select("uid", "scope", "role", "lo", "hi", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("d"), "cell").withColumn("cell", F.col("cell") + F.col("d"))
    here = lambda r, d, c: F.when((F.col("role") == r) & (F.col("d") == d), F.col(c))
    around = told.groupBy("uid", "scope", "cell").agg(*[c for r in ROLES for c in (F.max(here(r, 1, "hi")).alias(f"{r}_before"), F.max(here(r, 0, "lo")).alias(f"{r}_same"), F.min(here(r, -1, "lo")).alias(f"{r}_after"))])
    near = {r: F.col(f"{r}_same").isNotNull() | F.coalesce(F.col("start") - F.col(f"{r}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{r}_after") - F.col("start") <= reach, F.lit(False)) for r in ROLES}
    met = parts.filter("weak").withColumn("cell", cell).join(around, ["uid", "scope", "cell"])
    return met.filter(complementary(near, F.col("role"))).select(*parts.columns)


def _reported(rows: DataFrame) -> DataFrame:
    """Weak parts of the scanned ``rows`` that are reported."""
    each = lambda c, weak: rows.filter(F.size("weak") > 0).select("uid", "doc_id", F.explode(c).alias("x"), F.lit(weak).alias("weak")).select("uid", "doc_id", "x.*", "weak")
    return linked(each("base", False).unionByName(each("weak", True)))


def credentials(docs: DataFrame) -> DataFrame:
    """uid (of a row of ``docs``), doc_id, kind, role, start, end, value, scope, weak of every part found: base ones, and weak
    ones with complementary parts in reach. The rest is as ``secret_spans`` says."""
    rows = scan(docs)
    base = rows.select("uid", "doc_id", F.explode("base").alias("x")).select("uid", "doc_id", "x.*", F.lit(False).alias("weak"))
    return base.unionByName(_reported(rows)).select("uid", "doc_id", "kind", "role", "start", "end", "value", "scope", "weak")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of ``docs``.

    base_sha256 is of the base spans as kind:start:end, by start, then kind; ``spans`` holds these and the added ones, in the
    same order. Texts are worked on whole, however long: patterns are linear in them. Null and empty texts have no spans;
    repeated rows and rows that repeat a doc_id have a row each, null ids stay null; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    rows = scan(docs)
    short = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("no"), x["end"].alias("end"), x["kind"].alias("kind")))
    added = _reported(rows).groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    both = rows.select("uid", "doc_id", "base").join(added, "uid", "left")
    every = F.array_sort(F.when(F.col("added").isNull(), short("base")).otherwise(F.concat(short("base"), short("added"))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    out = durable(both.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans")))
    forget(rows)
    return out
