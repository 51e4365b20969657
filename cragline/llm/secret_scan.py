"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base candidates are found by pattern in every whole text: assignments, access keys, hex runs. The
method adds opaque tokens (20 or more characters of a token alphabet with a letter and at least two
digits, outside base spans) that look drawn at random: letters and digits take turns, or small letters and capitals do, far more
often than in words, slugs, paths, dates and identifiers. Of a token's letters and digits TURNS in a hundred must be followed by the other kind, or
there must be RUNS in a hundred runs (a capital and the small letters after it are one); somewhere it needs UNBROKEN of them in a row, which
sets UUIDs and lists of short codes apart. Every candidate's value is hashed; over the corpus each hash is counted by
distinct repositories and owners. A value that COPIED or more owners hold is a widely copied
example; one that a single owner holds is live-looking; others are shared. Opaque tokens count as secrets
unless they are examples; base spans always stay.

One pass of each pattern cuts a text into what lies between matches and the matches; positions (code
points, end exclusive) are running sums of their lengths and overlaps are running extremes, both windows
over a row's pieces, so work is linear in a text and its matches and no Python runs anywhere.

Defined results: a null text is empty; no match gives zeros, the digest of the empty string and an
empty span list; repeated rows count each in their row but once per owner; a null repository or
owner is one like any other; an empty table gives an empty result; extra columns are ignored, and stay in
what ``redact`` returns. ``redact`` goes by a row's text alone, so null ids, shared ids and repeated rows
change nothing; a null text stays null. Whole texts of any length are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, fingerprint, fresh, join_hot, materialize

KINDS = ("assign", "access", "hex", "opaque")
COPIED = 3  #: owners from which on a value is a widely copied example
CUT = "\x00"  #: stands around matches; one in a text is read as \\x01, which no pattern holds either
TURNS, RUNS = 15, 35  #: from letter to digit or back, and runs of one kind, in a hundred letters and digits of a live-looking token
UNBROKEN = 13  #: characters between ``/ _ -`` that it has somewhere; groups of a UUID have 12 at most
MANY = 1000  #: marks from which on a text is taken apart once instead of being cut mark by mark
#: The keywords and alphabets of the three base patterns.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(?:%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
OPAQUE = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"


def either_case(words: tuple[str, ...] = KEYWORDS) -> str:
    """An alternation whose ASCII letters match in either case, in any regex dialect."""
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


ASSIGN_RE = ASSIGN % either_case()
ANY_RE = f"{ASSIGN_RE}|{ACCESS}|[0-9a-zA-Z+/_-]{{20,}}"  #: every text with a candidate matches this


def _value(match: Column, kind: str) -> Column:
    return F.regexp_extract(match, f"^{ASSIGN_RE}$", 1) if kind == "assign" else match


def live_looking(token: Column) -> Column:
    """Whether the kinds of characters of a token change as often as in a random one."""
    count = lambda pattern: F.size(F.regexp_extract_all(token, F.lit(pattern), F.lit(0)))
    length = F.char_length(F.regexp_replace(token, "[+/_-]", ""))
    turns = count("[A-Za-z]+|[0-9]+") - count("[A-Za-z0-9]+")
    return token.rlike(f"[A-Za-z0-9+]{{{UNBROKEN}}}") & ((turns * 100 >= length * TURNS) | (count("[A-Z]?[a-z]+|[A-Z]+|[0-9]+") * 100 >= length * RUNS))


def _pieces(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<rank, i, length, hash>>: what lies between matches at even i, matches at odd i; null hash: no candidate."""
    cut = F.split(F.regexp_replace(text, f"(?:{pattern})", f"{CUT}$0{CUT}"), CUT, -1)

    def piece(x: Column, i: Column) -> Column:
        value = _value(x, kind)
        fit = {"assign": F.char_length(value) >= 6, "opaque": live_looking(x)}.get(kind, F.lit(True))
        keep = (i % 2 == 1) & fit
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("i"), F.char_length(x).alias("length"), F.when(keep, F.xxhash64(value)).alias("hash"))

    return F.transform(cut, piece)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(row, doc_id, repository, owner, k1, k2, pieces) of every row; pieces hold value hashes, not values.

    k1, k2: the text's fingerprint where it may hold a candidate, else null.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), text.alias("text"))
    hit = F.col("text").rlike(ANY_RE)  # one look decides whether a text is worth the patterns
    rows = rows.withColumn("text", F.when(hit, F.col("text")))
    clean = F.translate("text", CUT, "\x01")
    arrays = [_pieces(clean, p, k) for k, p in zip(KINDS, (ASSIGN_RE, ACCESS, HEX, OPAQUE), strict=True)]
    key = [F.when(F.col("text").isNotNull(), k).alias(n) for k, n in zip(fingerprint("text"), ("k1", "k2"), strict=True)]
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", *key, F.concat(*arrays).alias("pieces"))


def _spans(found: DataFrame) -> DataFrame:
    """(row, repository, owner, k1, k2, rank, at, to, hash) of every candidate; opaque ones only outside base spans."""
    some = found.where(F.size("pieces") > len(KINDS)).select("row", "repository", "owner", "k1", "k2", F.explode("pieces").alias("p")).select("row", "repository", "owner", "k1", "k2", "p.*")
    some = some.repartition("row")  # all windows below are of one row
    to = F.sum("length").over(Window.partitionBy("row", "rank").orderBy("i")).cast("int")
    some = some.withColumn("to", to).withColumn("at", F.col("to") - F.col("length")).where("hash is not null")
    base = F.col("rank") < KINDS.index("opaque")
    before, after = Window.partitionBy("row").orderBy("at", "rank", "to"), Window.partitionBy("row").orderBy(F.desc("at"), F.desc("rank"), F.desc("to"))
    some = some.withColumn("reach", F.max(F.when(base, F.col("to"))).over(before)).withColumn("next", F.min(F.when(base, F.col("at"))).over(after))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("at")) & (F.coalesce(F.col("next"), F.col("to")) >= F.col("to"))
    return some.where(base | free).select("row", "repository", "owner", "k1", "k2", "rank", "at", "to", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, repositories, owners, uses) of every candidate value; spans(row, repository, owner, hash)."""
    once = spans.groupBy("hash", "repository", "owner").agg(F.count("*").alias("uses"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    return once.groupBy("hash").agg(F.count_distinct(name(F.col("repository"))).alias("repositories"), F.count_distinct(name(F.col("owner"))).alias("owners"), F.sum("uses").alias("uses"))


def judged(found: DataFrame, copied: int = COPIED) -> DataFrame:
    """The candidates of ``found`` with repositories, owners, uses and verdict; opaque ones that are examples go."""
    each = materialize(_spans(found), "spans")
    counts = materialize(ownership(each), "ownership")
    each = join_hot(each, counts, ["hash"], "uses", each.count())  # a copied value may be in a third of all rows
    verdict = F.when(F.col("owners") >= copied, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    each = each.withColumn("verdict", verdict).withColumn("kind", kind)
    return each.where((F.col("kind") != "opaque") | (F.col("verdict") != "example"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, copied: int = COPIED) -> DataFrame:
    """(row, doc_id, spans) of every row; a span: at, rank, to, kind, repositories, owners, uses, verdict."""
    found = materialize(candidates(docs, id_col, text_col, repository, owner), "candidates")
    span = F.struct("at", "rank", "to", "kind", "repositories", "owners", "uses", "verdict")
    some = judged(found, copied).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    kept = found.select("row", "doc_id", (F.size("pieces") > len(KINDS)).alias("any"))
    none = F.array().cast(some.schema["spans"].dataType)
    with_spans = kept.where("any").join(some, "row", "left").select("row", "doc_id", F.coalesce("spans", none).alias("spans"))
    return with_spans.unionByName(kept.where(~F.coalesce("any", F.lit(False))).select("row", "doc_id", none.alias("spans")))


def joined(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["to"].cast("string"))))


def _marks(found: DataFrame, copied: int) -> DataFrame:
    """(k1, k2, n, cuts, tail): of each text with secrets, how many rows have it, what is kept before each mark, and after the last."""
    wanted = judged(found, copied).where("verdict <> 'example'").select("k1", "k2", "at", "to").distinct()
    past = F.coalesce(F.max("to").over(Window.partitionBy("k1", "k2").orderBy("at", "to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    merged = wanted.withColumn("past", past).withColumn("fresh", F.col("at") >= F.col("past"))
    cuts = F.sort_array(F.collect_list(F.when(F.col("fresh"), F.struct(F.col("past").alias("from"), "at"))))
    rows = found.where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return merged.groupBy("k1", "k2").agg(cuts.alias("cuts"), F.max("to").alias("tail")).join(rows, ["k1", "k2"])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", repository: Column | None = None, owner: Column | None = None, copied: int = COPIED) -> DataFrame:
    """``docs`` with every secret that is not a widely copied example replaced by ``mark``; other texts are untouched.

    Where secrets lie follows from the text and what the corpus says of its values, so marks meet rows by the
    text's fingerprint, never by id. Overlapping secrets share a mark.
    """
    found = materialize(candidates(docs, id_col, text_col, repository, owner), "candidates")
    marks = materialize(_marks(found, copied), "marks")
    least = max(2, -(-found.where("k1 is not null").count() // HOT_SHARE))
    k1, k2, hot, cuts, tail = (fresh(docs, n) for n in ("k1", "k2", "hot", "cuts", "tail"))
    text = F.col(text_col).cast("string")
    worth = F.coalesce(text.rlike(ANY_RE), F.lit(False))
    some = docs.where(worth)  # texts without any candidate meet nothing and do not move
    some = some.withColumns(dict(zip((k1, k2), fingerprint(text), strict=True)))
    # texts that many rows share number at most HOT_SHARE and are broadcast; their rows' keys are then spread
    often = marks.where(F.col("n") >= least).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.struct("cuts", "tail").alias(hot))
    rare = marks.where(F.col("n") < least).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("cuts").alias(cuts), F.col("tail").alias(tail))
    some = some.join(F.broadcast(often), [k1, k2], "left")
    met = F.col(hot).isNotNull()
    some = some.withColumns({k1: F.when(met, F.monotonically_increasing_id()).otherwise(F.col(k1)), k2: F.when(~met, F.col(k2))})
    some = some.join(rare.hint("merge"), [k1, k2], "left")
    some = some.withColumns({cuts: F.coalesce(F.col(cuts), F.col(hot)["cuts"]), tail: F.coalesce(F.col(tail), F.col(hot)["tail"])})
    kept = F.transform(cuts, lambda c: F.substring(text, c["from"] + 1, c["at"] - c["from"]))
    # cutting at each of very many marks would walk the text as often; its characters are then taken apart once
    apart = F.transform(F.array(F.split(text, "")), lambda t: F.transform(cuts, lambda c: F.array_join(F.slice(t, c["from"] + 1, c["at"] - c["from"]), "")))
    kept = F.when(F.size(cuts) > MANY, F.get(apart, F.lit(0))).otherwise(kept)
    clean = F.concat(F.array_join(kept, mark), F.lit(mark), F.substring(text, F.col(tail) + 1, F.char_length(text)))
    return some.withColumn(text_col, F.when(F.col(cuts).isNotNull(), clean).otherwise(F.col(text_col))).select(*docs.columns).unionByName(docs.where(~worth))
