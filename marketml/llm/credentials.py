"""Secret scan with multipart credential linking.

Plain rules report assignments, access identifiers and long hexadecimal runs
(the base spans).  Weaker parts are also taken: account identifiers, short or
unusual secret values, and service endpoints.  A weak part alone says little;
it is reported when a complementary part lies in the same scope: parts are
interval-joined within a document on the distance of their spans (at most ``scope``
code points), and a weak part is kept if a secret meets an identifier or an endpoint.

Scale: texts are scanned where they lie.  Only the parts of texts are
shuffled, keyed by document and a bin of ``scope`` code points, and joined
with the same and neighbouring bins, so a text with very many parts spreads
over many keys and each part meets only those near it.

Nulls and ties: a null text counts as empty and has no spans; rows are
joined by (doc_id, hash of text), so repeated rows and null ids get the spans of their
own text; extra columns are kept aside.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import give_back, prepare
from marketml.session import materialize

SCOPE = 256
#: Kinds in the order in which spans at one place are listed.
BASE = ("assign", "access", "hex")
WEAK = ("id_part", "secret_part", "endpoint_part")
KINDS = (*BASE, *WEAK)
#: What a kind can stand for in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id_part": "id", "secret_part": "secret", "endpoint_part": "endpoint"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a name starts: not after a letter ("_" and digits may precede it, as in DB_HOST), or at a capital after a small letter.
_NAME = r"(?-i:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
ID_PART = re.compile(_NAME + r"""(?:access[_\x20.-]?key(?:[_\x20.-]?id)?|(?:client|key|app|application|tenant|subscription|role|project)[_\x20.-]?id|user(?:[_\x20.-]?(?:name|id))?|uid|login|account(?:[_\x20.-]?(?:name|id))?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]{3,})""", re.I | re.A)
SECRET_PART = re.compile(_NAME + r"""(?:pass(?:w(?:or)?d|phrase|code)?|pwd|secret(?:[_\x20.-]?id)?|token|api[_\x20.-]?key|(?:secret[_\x20.-]?access|shared[_\x20.-]?access|private|secret|account|shared|storage|master|signing|encryption|auth)[_\x20.-]?key|client[_\x20.-]?secret|credentials?|auth|sig(?:nature)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})""", re.I | re.A)
ENDPOINT_PART = re.compile(r"""(?<![A-Za-z])(?:https?|s?ftp|ssh|ldaps?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|s3)://[^\s"'<>]+|""" + _NAME + r"""(?:host(?:[_\x20.-]?name)?|endpoint(?:[_\x20.-]?suffix)?|server|data[_\x20.-]?source|url|uri|dsn)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}""", re.I | re.A)

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_WORDS = ("pass", "secret", "token", "api")
_WEAK_WORDS = ("://", "host", "endpoint", "server", "source", "url", "uri", "dsn", "key", "id", "user", "login", "account", "pass", "pwd", "secret", "token", "credential", "auth", "sig")

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])


def _has_hex_run(data: bytes) -> bool:
    """Whether 24 hexadecimal bytes in a row are possible: any such run holds
    three consecutive multiples of eight."""
    hit = _HEX_BYTE[np.frombuffer(data, np.uint8)[::8]]
    return bool((hit[:-2] & hit[1:-1] & hit[2:]).any()) if len(hit) > 2 else bool(hit.any())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain rules, sorted."""
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if len(text) >= 24 and (not text.isascii() or _has_hex_run(text.encode())):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak parts that no base span overlaps."""
    low = text.lower()
    if not any(w in low for w in _WEAK_WORDS):
        return []
    ends, reach = [], 0
    for _, _, e in base:
        reach = max(reach, e)
        ends.append(reach)
    starts, out = [s for s, _, _ in base], []
    secrets = list(SECRET_PART.finditer(text))
    values = {m.start(1) for m in secrets}
    # The access key that ends "secret_access_key" is no identifier beside itself.
    ids = [m for m in ID_PART.finditer(text) if m.start(1) not in values]
    for kind, found in ((3, ids), (4, secrets), (5, ENDPOINT_PART.finditer(text))):
        for m in found:
            k = bisect_right(starts, m.end() - 1) - 1
            if k < 0 or ends[k] <= m.start():
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@F.arrow_udf(T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("weak", T.ArrayType(SPAN))]))
def _scan(texts: pa.Array) -> pa.Array:
    give_back()
    base, weak = [], []
    for t in texts:  # one text at a time is a Python string
        t = t.as_py() or ""
        base.append(base_spans(t))
        weak.append(weak_parts(t, base[-1]))
    rows = lambda spans: [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans]
    return pa.StructArray.from_arrays([pa.array(rows(base), pa.list_(_SPAN)), pa.array(rows(weak), pa.list_(_SPAN))], ["base", "weak"])


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak rows of ``parts`` (id, text_key, start, kind, end) that have a
    complementary part at most ``scope`` code points away: an interval
    join, on bins of ``scope``."""
    role = F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(ROLE[n] for n in KINDS) for x in (k, v)]), F.col("kind"))
    side = parts.distinct().withColumn("role", role)
    # A part is filed under each bin that its span, widened by the scope, touches; its partners under the bins they cover.
    near = side.where(F.col("kind") >= len(BASE)).withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    other = side.select(F.col("id").alias("o_id"), F.col("text_key").alias("o_key"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"),
                        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"))
    other = other.withColumnRenamed("bin", "o_bin")
    complementary = ((F.col("role") == "secret") & (F.col("o_role") != "secret")) | ((F.col("role") != "secret") & (F.col("o_role") == "secret"))
    close = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    return near.join(other, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("text_key") == F.col("o_key")) & (F.col("bin") == F.col("o_bin")) & close & complementary, "left_semi").select("id", "text_key", "start", "kind", "end").distinct()


def find_credentials(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, base, spans) and the columns ``keep`` for every row: arrays of
    (start, kind, end), ``kind`` an index into KINDS; ``spans`` holds the base spans
    and the linked weak parts in order."""
    prepare(docs.sparkSession)
    scanned = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), _scan(F.col(text)).alias("s"))
    found = materialize(scanned.select("id", "text_key", "s.base", "s.weak"), "credentials")
    holds = found.where(F.size("weak") > 0)
    parts = holds.select("id", "text_key", F.explode(F.concat("base", "weak")).alias("p")).select("id", "text_key", "p.*")
    linked = linked_parts(parts, scope).groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    rows = found.select("id", "text_key", "base")
    if keep:
        # One row for each (id, text): repeated rows would multiply in the join.
        rows = docs.select(*keep, F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")).join(
            rows.where(F.size("base") > 0).distinct().withColumnsRenamed({"id": "b_id", "text_key": "b_key"}), F.expr("id <=> b_id and text_key = b_key"), "left").drop("b_id", "b_key")
    linked = linked.withColumnsRenamed({"id": "l_id", "text_key": "l_key"})
    empty = F.array().cast(T.ArrayType(SPAN))
    out = rows.join(linked, F.expr("id <=> l_id and text_key = l_key"), "left")
    base = F.coalesce("base", empty)
    return out.select(*keep, "id", base.alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", empty))).alias("spans"))


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _mask(text: str, found) -> str:
    """``text`` with the spans (start, kind, end) replaced by their kinds; of spans that overlap the first names the place."""
    parts, at = [], 0
    for start, k, end in found:
        if end > at:
            if start >= at:
                parts += [text[at:start], f"[{KINDS[k]}]"]
            at = end
    return "".join(parts) + text[at:]


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    give_back()
    return pa.array([t if not found else _mask(t, [(s["start"], s["kind"], s["end"]) for s in found]) for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.IntegerType()), T.StructField("weak", T.BooleanType())]))
def _scan_masked(texts: pa.Array) -> pa.Array:
    """Each text with its base spans masked, their number, and whether it has weak parts (then it is left out)."""
    give_back()
    rows = []
    for t in texts:
        t = t.as_py()
        base = base_spans(t or "")
        weak = bool(weak_parts(t or "", base))
        rows.append((None if weak else _mask(t, base) if base else t, len(base), weak))
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["text", "spans", "weak"])


def redact(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id", length: str | None = None) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in
    brackets, and ``length``, if named, counted anew for changed texts."""
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    names = dict(zip(columns, renamed.columns, strict=True))
    body, empty = F.col(names[text]), F.array().cast(T.ArrayType(SPAN))
    prepare(docs.sparkSession)
    # Only texts with weak parts can gain a span, so only these are written and joined; all others are masked where they lie.
    alone = renamed.withColumn("s", _scan_masked(body)).where(~F.col("s.weak"))
    alone = alone.withColumn(names[text], F.col("s.text")).select(*renamed.columns, (F.col("s.spans") > 0).alias("changed"))
    holds = renamed.withColumn("s", _scan(body)).where(F.size("s.weak") > 0)
    holds = materialize(holds.select(*renamed.columns, F.col(names[doc_id]).alias("id"), F.xxhash64(body).alias("text_key"), "s.base", "s.weak"), "credentials")
    parts = holds.select("id", "text_key", F.explode(F.concat("base", "weak")).alias("p")).select("id", "text_key", "p.*")
    linked = linked_parts(parts, scope).groupBy(F.col("id").alias("l_id"), F.col("text_key").alias("l_key")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    joined = holds.join(linked, F.expr("id <=> l_id and text_key = l_key"), "left")
    joined = joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("linked", empty)))).withColumn("changed", F.size("spans") > 0)
    joined = joined.withColumn(names[text], _masked(body, F.col("spans"))).select(*renamed.columns, "changed")
    new = alone.unionByName(joined)
    if length:
        kind = dict(docs.dtypes)[length]
        new = new.withColumn(names[length], F.when(F.col("changed"), F.length(names[text]).cast(kind)).otherwise(F.col(names[length])))
    return new.select(*[F.col(names[c]).alias(c) for c in columns])
