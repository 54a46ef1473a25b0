"""Secret scans with multipart credential linking, DataFrame functions only.

Parts of credentials are found by patterns with their places in the text
(code points, end exclusive). Strong parts (assignments, access identifiers,
long hexadecimal runs) are reported wherever they stand. Weak candidates are
reported only with complementary parts within `reach` code points in the same
scope (scopes end at blank lines): an unassigned mixed-case key near an
identifier, an account name near a secret, an endpoint near both.

Method. Places come from the text between matches: a match starts where the
gaps and matches before it end, a running sum. All parts of all texts then
form one table, and the interval join of identifiers, secrets and endpoints
is a pass over (document, scope) in order of place: range frames tell whether
complementary parts are within reach, and the last and next identifier and
endpoint give the links, so a scope with many parts costs a sort and no
pairs. Only parts are shuffled, never texts.

Defined results: a null text counts as empty; a row without parts is returned
with zero counts, empty spans and no links; rows that agree in id and text
are returned as often as they come; rows with a null id are kept (id null);
of an identifier before and one behind at equal distance the one before is
linked; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Code points between complementary parts, at most.
REACH = 400
_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ACCOUNT = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("client_?id", "username", "login"))
#: kind: (pattern, its group that must be long enough, least length), in the order of kinds.
PATTERNS = {
    "assign": (rf"({_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "key": (r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    "account": (rf"({_ACCOUNT})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]+)", 2, 3),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9._~/?%&=+-]*)?", 0, 1),
    "break": (r"\n[\x20\x09]*\n", 0, 1),
}
BASE = ("assign", "access", "hex")
_KINDS = list(PATTERNS)


def _found(kind: str):
    """Array of the matches of one kind: gap before it, length, whether it counts."""
    pattern, group, least = PATTERNS[kind]
    text, p = F.col("text"), F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole

    def part(g, w, v):
        ok = F.char_length(v) >= least
        if kind == "key":
            ok = ok & v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
        return F.struct(
            F.lit(_KINDS.index(kind)).alias("kind"), F.char_length(g).alias("gap"), F.char_length(w).alias("len"), ok.alias("ok")
        )

    zipped = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v")), lambda x: part(x["g"], x["w"], x["v"]))
    return F.when(text.rlike(pattern), F.filter(zipped, lambda x: x["len"].isNotNull()))


def _nearest(kinds, order: Window, reach: int):
    """Span (start, kind, end) of the nearest part of some kinds before or behind a row, within reach of starts."""
    span = F.when(kinds, F.struct("start", "kind", "end"))
    before = F.last(span, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(span, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    back, ahead = F.col("start") - before["start"], behind["start"] - F.col("start")
    take = F.when(behind.isNull() | (before.isNotNull() & (back <= ahead)), before).otherwise(behind)
    return F.when(F.least(back, ahead) <= reach, take)


def credential_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, text_hash, kind, start, end, reported, identifier and endpoint of a secret; and one row with null kind for every text, with its copies."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean>>")
    found = [F.coalesce(_found(k), none) for k in _KINDS]
    # one part without a kind keeps every text in the table
    blank = F.lit(None).cast("int")
    parts = F.concat(*found, F.array(F.struct(blank.alias("kind"), blank.alias("gap"), blank.alias("len"), F.lit(True).alias("ok"))))
    at = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    in_text = Window.partitionBy("doc_id", "text_hash").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    in_scope = Window.partitionBy("doc_id", "text_hash", "scope")
    near = in_scope.orderBy("start").rangeBetween(-reach, reach)
    kind = {k: F.col("kind") == _KINDS.index(k) for k in _KINDS}
    who, what = kind["access"] | kind["account"], kind["assign"] | kind["hex"] | kind["key"]
    identifier = F.sum(F.when(who, 1).otherwise(0)).over(near) > 0
    secret = F.sum(F.when(what, 1).otherwise(0)).over(near) > 0
    base = kind["assign"] | kind["access"] | kind["hex"]
    other = F.max(F.when(base | kind["account"] | kind["endpoint"], F.col("end"))).over(in_text)
    order = in_scope.orderBy("start", "kind")
    return (
        rows.select("doc_id", "text_hash", F.posexplode(parts).alias("i", "p"))
        .groupBy("doc_id", "text_hash", "i", "p")
        .agg(F.count("*").alias("copies"))
        .select("doc_id", "text_hash", "i", "copies", "p.*")
        .repartition("doc_id", "text_hash")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(at))
        .withColumn("start", F.col("end") - F.col("len"))
        .where("ok")
        .withColumns({"scope": F.sum(F.when(kind["break"], 1).otherwise(0)).over(in_text), "covered": kind["key"] & F.coalesce(other > F.col("start"), F.lit(False))})
        .where(~F.coalesce("covered", F.lit(False)))
        .withColumns(
            {
                "reported": base | (kind["key"] & identifier) | (kind["account"] & secret) | (kind["endpoint"] & identifier & secret),
                "identifier": F.when(what, _nearest(who, order, reach)),
                "endpoint": F.when(what, _nearest(kind["endpoint"], order, reach)),
            }
        )
        .select("doc_id", "text_hash", "kind", "start", "end", "reported", "identifier", "endpoint", "copies")
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: counts of base kinds, all reported spans in order (array of start, kind, end) and links (array of secret, identifier, endpoint)."""
    parts = credential_parts(docs, id_col, text_col, reach)
    span = F.struct("start", "kind", "end")
    link = F.struct(span.alias("secret"), "identifier", "endpoint")
    out = parts.groupBy("doc_id", "text_hash").agg(
        *(F.count_if(F.col("kind") == _KINDS.index(k)).alias(f"n_{k}") for k in BASE),
        F.array_sort(F.collect_list(F.when(F.col("kind") < len(BASE), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("identifier").isNotNull(), link))).alias("links"),
        F.max(F.when(F.col("kind").isNull(), F.col("copies"))).alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")


def told(span):
    """kind:start:end of a span."""
    names = F.array(*(F.lit(k) for k in _KINDS))
    return F.concat_ws(":", F.get(names, span["kind"]), span["start"].cast("string"), span["end"].cast("string"))


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, told), ",")


def joined_links(links):
    """secret<identifier, and @endpoint where there is one, of each link, comma-joined."""
    end = lambda k: F.when(k["endpoint"].isNotNull(), F.concat(F.lit("@"), told(k["endpoint"]))).otherwise("")
    return F.array_join(F.transform(links, lambda k: F.concat(told(k["secret"]), F.lit("<"), told(k["identifier"]), end(k))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by `mark`; all columns and rows stay, texts without findings are unchanged."""
    found = (
        scan_secrets(docs, id_col, text_col)
        .where(F.size("found") > 0)
        .select("doc_id", "text_hash", "found")
        .dropDuplicates(["doc_id", "text_hash"])
    )
    text = F.col(f"row.{text_col}")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        kept = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, F.when(fresh, mark).otherwise("")).alias("out")
        )

    def finish(acc):
        return F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))

    clean = F.when(F.col("found").isNull(), text).otherwise(F.aggregate("found", start, step, finish))
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(found, same, "left")
    return rows.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
