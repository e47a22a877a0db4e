"""Secret scan with multipart credential linking, in DataFrame functions only.

Places of matches come from the text itself: ``split`` by a pattern gives what
lies between its matches, ``regexp_extract_all`` the matches, and a running sum
of both lengths gives every start.

Parts of a credential are an identifier (access, id), a secret (assign, hex, key)
and an endpoint.  Weak candidates (a user-like id, a long bare key, an endpoint)
are reported only if parts that complete them start within one ``scope`` of code
points: an id or a key needs the other, an endpoint needs both.  No part shares
characters with another: a weak candidate that overlaps a base span is none, nor
is an id or a key inside an endpoint, a key inside an id, and a base secret that
overlaps an access identifier is not a secret to it.  The interval join of a
document's candidates with themselves needs no pairs, as the nearest part on
either side decides; running windows in both directions find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in report order.  "In either case" is ASCII: a long s or a Kelvin sign is no s or k.  Base kinds are always reported, the others when linked.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
}
WEAK = {
    "id": r"""(?i:(?:user_?name|user|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "key": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}",
    "endpoint": r"""(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|s3)://[A-Za-z0-9._:@/?&=%+-]{4,}""",
}
KINDS = [*BASE, *WEAK]
MIN_VALUE = 6


def _matches(text: Column) -> list[Column]:
    """For each kind an array of its matches."""
    return [F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"hit_{k}") for k, p in (BASE | WEAK).items()]


def _placed(kind: str, pattern: str) -> Column:
    """An array of (rank, i, size, gap, value): the i-th match, and the length of what lies before it."""
    hits, rank = F.col(f"hit_{kind}"), KINDS.index(kind)
    sizes = F.transform(hits, lambda h, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.char_length(h).alias("size")))
    out = F.zip_with(sizes, F.split("t", pattern, -1), lambda h, g: h.withField("gap", F.char_length(g)))
    if kind == "assign":
        out = F.zip_with(out, F.col("val_assign"), lambda h, v: h.withField("value", F.char_length(v)))
    else:
        out = F.transform(out, lambda h: h.withField("value", F.lit(MIN_VALUE)))
    # The last gap has no match: zip_with pads it with a null.
    some = F.filter(out, lambda h: h["size"].isNotNull())
    return F.when(F.size(hits) > 0, some).otherwise(F.array().cast("array<struct<rank:int,i:int,size:int,gap:int,value:int>>"))


def _token(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))


def spans(docs: DataFrame, scope: int = 300) -> DataFrame:
    """_row, doc_id, kind, rank, start, end, link: the reported spans of every row, and a row with a null kind for each document.

    Equal rows are kept apart by ``_row``.  Places are code points, ends exclusive.
    link: the parts (identifier, secret and endpoint) that the span completes, or null.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = rows.select("_row", "doc_id", "t", *_matches(F.col("t")), F.regexp_extract_all("t", F.lit(BASE["assign"]), F.lit(2)).alias("val_assign"))
    flat = found.select("_row", "doc_id", F.explode_outer(F.concat(*[_placed(k, p) for k, p in (BASE | WEAK).items()])).alias("m")).select("_row", "doc_id", "m.*").repartition("_row")
    before = Window.partitionBy("_row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumn("start", (F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")).cast("long"))
    # A failing match is blanked, not dropped, so that its document keeps a row.
    rank = F.when(F.col("value") >= MIN_VALUE, F.col("rank"))
    placed = placed.select("_row", "doc_id", rank.alias("rank"), "start", (F.col("start") + F.col("size")).alias("end"))
    placed = placed.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1))

    # Running values in both directions: each is one pass over a document's candidates.
    up = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def overlaps(*kinds: str) -> Column:
        """Whether the span shares characters with one of these kinds, of which it is not one itself."""
        there = F.col("kind").isin(*kinds)
        return F.coalesce(F.max(F.when(there, F.col("end"))).over(up) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(there, F.col("start"))).over(down) < F.col("end"), F.lit(False))

    marked = placed.select("*", overlaps(*BASE).alias("_base"), overlaps("access").alias("_access"), overlaps("endpoint").alias("_endpoint"), overlaps("id").alias("_id"))
    kind = F.col("kind")
    part = (
        F.when((kind == "access") | (kind == "id") & ~F.col("_base") & ~F.col("_endpoint"), "identifier")
        .when(kind.isin("assign", "hex") & ~F.col("_access") | (kind == "key") & ~F.col("_base") & ~F.col("_endpoint") & ~F.col("_id"), "secret")
        .when((kind == "endpoint") & ~F.col("_base"), "endpoint")
    )
    marked = marked.select("_row", "doc_id", "rank", "start", "end", "kind", part.alias("part"))
    here = F.struct("start", "end", "kind")
    near = [f(F.when(F.col("part") == p, here)).over(w).alias(f"{p}_{side}") for p in ("identifier", "secret") for side, f, w in (("before", F.max, up), ("after", F.min, down))]
    known = marked.select("*", *near)

    def closest(*sides: str) -> Column:
        """The nearer of the two in scope, the earlier of equally near ones."""
        away = lambda c: F.abs(F.col(f"{c}.start") - F.col("start"))
        best = F.array_min(F.array_compact(F.array(*[F.when(away(c) <= scope, F.struct(away(c).alias("away"), F.col(c).alias("x"))) for c in sides])))
        return best["x"]

    def together(i: str, s: str) -> Column:
        """Identifier, secret and this endpoint, if they start within one scope; and how far apart."""
        places = [F.col(f"{i}.start"), F.col(f"{s}.start"), F.col("start")]
        away = F.greatest(*places) - F.least(*places)
        return F.when(F.col(i).isNotNull() & F.col(s).isNotNull() & (away <= scope), F.struct(away.alias("away"), F.col(i).alias("i"), F.col(s).alias("s")))

    sides = ("before", "after")
    three = F.array_min(F.array_compact(F.array(*[together(f"identifier_{a}", f"secret_{b}") for a in sides for b in sides])))
    secret, identifier = closest("secret_before", "secret_after"), closest("identifier_before", "identifier_after")
    none = F.lit(None).cast("struct<start:bigint,end:bigint,kind:string>")
    link = (
        F.when((F.col("part") == "identifier") & secret.isNotNull(), F.struct(here.alias("i"), secret.alias("s"), none.alias("e")))
        .when((F.col("part") == "secret") & identifier.isNotNull(), F.struct(identifier.alias("i"), here.alias("s"), none.alias("e")))
        .when((F.col("part") == "endpoint") & three.isNotNull(), F.struct(three["i"].alias("i"), three["s"].alias("s"), here.alias("e")))
    )
    out = known.select("_row", "doc_id", "rank", "start", "end", "kind", link.alias("link"))
    told = F.col("rank").isNotNull() & ((F.col("rank") < len(BASE)) | F.col("link").isNotNull())
    return out.select("_row", "doc_id", F.when(told, F.col("kind")).alias("kind"), F.when(told, F.col("rank")).alias("rank"), "start", "end", "link")


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and links of every row of ``docs`` (doc_id, text).

    links has, for every span that others complete, which parts belong together: identifier+secret
    or identifier+secret+endpoint, each once.  Null counts as empty; a text without spans has zero
    counts, the digest of the empty string and empty lists.  Repeated rows are scanned once each.
    """
    s = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "rank", "kind", "end")))
    links = F.array_sort(F.collect_set(F.col("link")))
    shown = lambda a: F.array_join(F.transform(a, _token), ",")
    grouped = spans(docs, scope).groupBy("_row", "doc_id").agg(F.array_sort(s).alias("s"), links.alias("links"))
    base = F.filter("s", lambda x: x["rank"] < len(BASE))
    counts = [F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    told = F.array_join(F.transform("links", lambda x: F.concat_ws("+", _token(x["i"]), _token(x["s"]), F.when(x["e"].isNotNull(), _token(x["e"])))), ",")
    return grouped.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"), told.alias("links"))
