"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong findings (assignments, access key ids, long hex strings) are always reported.  Weak candidates - a token
that looks like an identifier or like a generated secret, an endpoint - are common by themselves; one is
reported only where complementary parts stand within one scope: an identifier or an endpoint near a secret, a
secret near an identifier or an endpoint.  Strong findings count as parts, too.

The scope is a distance in code points.  Parts are dealt by document and stretch of text, so a very long text
is spread over many groups, and a semi join on the stretch with the distance as condition keeps a candidate once
per stretch; pairs are never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.storage import written

# The patterns of the strong findings.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# The patterns of weak candidates.
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?i:(?:host|endpoint|server|url))\x20*[:=]\x20*[A-Za-z0-9./:_-]{4,}"
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
IDENTIFIER_LENGTH = (12, 64)
SECRET_LENGTH = (20, 128)

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
#: The part of a credential that each kind stands for.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}
SCOPE = 100
_STRETCH = 1_024
_SPANS = "array<struct<start:int,end:int,match:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points, end exclusive.

    The texts between the matches and the matches themselves add up to the places.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.filter(
        F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("n"), m.alias("match"))),
        lambda x: x["match"].isNotNull(),
    )

    def add(at: Column, x: Column) -> Column:
        start = at["at"] + x["skip"]
        end = start + x["n"]
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(at["found"], F.array(span)).alias("found"))

    def placed(run: Column) -> Column:
        """Spans of one run, counted from its own start, with its length."""
        first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))
        return F.aggregate(run, first, add)

    def follow(at: Column, run: Column) -> Column:
        begun = F.concat(at["begun"], F.array(at["at"]))
        return F.struct((at["at"] + run["at"]).alias("at"), begun.alias("begun"))

    def shifted(run: Column, by: Column) -> Column:
        move = lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["match"].alias("match"))
        return F.transform(run["found"], move)

    def joined(runs: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begun"))
        return F.flatten(F.zip_with(runs, F.aggregate(runs, first, follow, lambda at: at["begun"]), shifted))

    found = _let(both, lambda x: _let(F.transform(_runs(x), placed), joined))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(items: Column) -> Column:
    """An array cut into runs of about the square root of its size, so that work within runs and over runs, each
    quadratic in its own number, stays small for any array."""
    size = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
    starts = F.when(size > 0, F.sequence(F.lit(1), size, width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(items, at, width))


def _kept(column: Column, kind: str, test) -> Column:
    kept = F.filter(column, test) if test else column
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))


def _is_identifier(s: Column) -> Column:
    low, high = IDENTIFIER_LENGTH
    return s["match"].rlike(f"^[A-Z0-9]{{{low},{high}}}$") & s["match"].rlike("[A-Z]") & s["match"].rlike("[0-9]")


def _is_secret(s: Column) -> Column:
    low, high = SECRET_LENGTH
    inside = F.length(s["match"]).between(low, high)
    return inside & s["match"].rlike("[A-Z]") & s["match"].rlike("[a-z]") & s["match"].rlike("[0-9]")


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, strong, weak): spans as (start, end, kind), weak ones apart from all strong ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = df.select(
        F.col(id_col),
        F.xxhash64(text).alias("text_hash"),
        spans(text, ASSIGN).alias("assign"),
        spans(text, ACCESS).alias("access"),
        spans(text, HEX).alias("hex"),
        spans(text, TOKEN).alias("tokens"),
        spans(text, ENDPOINT).alias("endpoint"),
    )
    strong = F.concat(
        _kept(F.col("assign"), "assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_VALUE),
        _kept(F.col("access"), "access", None),
        _kept(F.col("hex"), "hex", None),
    )
    weak = F.concat(
        _kept(F.col("tokens"), "id", _is_identifier),
        _kept(F.col("tokens"), "secret", _is_secret),
        _kept(F.col("endpoint"), "endpoint", None),
    )
    apart = _let(_let(F.array_sort("strong"), _hulls), lambda hulls: F.filter("weak", lambda w: ~_meets(w, hulls)))
    return raw.select(id_col, "text_hash", strong.alias("strong"), weak.alias("weak")).withColumn("weak", apart)


def _hulls(ordered: Column) -> Column:
    """Runs of spans in order with the stretch of text that each covers."""

    def hull(run: Column) -> Column:
        return F.struct(F.array_min(run["start"]).alias("start"), F.array_max(run["end"]).alias("end"), run.alias("spans"))

    return F.transform(_runs(ordered), hull)


def _meets(w: Column, hulls: Column) -> Column:
    def overlaps(s: Column) -> Column:
        return (w["start"] < s["end"]) & (s["start"] < w["end"])

    return F.exists(hulls, lambda h: overlaps(h) & F.exists(h["spans"], overlaps))


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), kind + 1)


def linked(found: DataFrame, id_col: str, scope: int = SCOPE) -> DataFrame:
    """(id, text_hash, linked): the weak spans that have a complementary part within ``scope`` code points."""

    def parts(column: str, reach: int) -> DataFrame:
        rows = found.where(F.size("weak") > 0).select(id_col, "text_hash", F.explode(column).alias("s"))
        stretches = F.sequence(((F.col("s.start") - reach) / _STRETCH).cast("int"), ((F.col("s.end") + reach) / _STRETCH).cast("int"))
        return rows.select(id_col, "text_hash", "s.*", _role(F.col("s.kind")).alias("role"), F.explode(stretches).alias("stretch"))

    w = parts("weak", scope).alias("w")
    p = parts("weak", 0).unionByName(parts("strong", 0)).alias("p")
    near = (F.col("w.start") - F.col("p.end") <= scope) & (F.col("p.start") - F.col("w.end") <= scope)
    complement = (F.col("w.role") == "secret") != (F.col("p.role") == "secret")
    same = F.col(f"w.{id_col}").eqNullSafe(F.col(f"p.{id_col}")) & (F.col("w.text_hash") == F.col("p.text_hash"))
    kept = w.join(p, same & (F.col("w.stretch") == F.col("p.stretch")) & near & complement, "left_semi")
    return kept.groupBy(id_col, "text_hash").agg(F.collect_set(F.struct("start", "end", "kind")).alias("linked"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, strong, linked) for every row: arrays of (start, end, kind), kind a place in ``KINDS``.

    A null text counts as empty, with empty arrays; a null id keeps its row; rows that repeat an id are scanned
    each by its own text; an empty table gives no rows; other columns are not read.
    """
    found = written(candidates(df, id_col, text_col), "secret-candidates")
    links = linked(found, id_col, scope).alias("l")
    f = found.alias("f")
    same = F.col(f"f.{id_col}").eqNullSafe(F.col(f"l.{id_col}")) & (F.col("f.text_hash") == F.col("l.text_hash"))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return f.join(links, same, "left").select(f"f.{id_col}", "f.strong", F.coalesce("l.linked", none).alias("linked"))


def listing(found: Column) -> Column:
    """kind:start:end of all spans by start, then kind, joined by commas."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
