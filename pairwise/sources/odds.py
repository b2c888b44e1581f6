"""Price files: one row per contest with a column pair per bookmaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwise.functions.numeric import known, lookup, number, strip, whole
from pairwise.operators import names
from pairwise.operators.clean import clean_surface
from pairwise.operators.history import day_number
from pairwise.session import via_table
from pairwise.sources.layouts import read_layouts

# --- fixed values: column prefixes and the series vocabulary ----------------------
BOOKS = {
    "ps": "PS", "b365": "B365", "ex": "EX", "lb": "LB", "sj": "SJ", "ub": "UB", "cb": "CB",
    "gb": "GB", "iw": "IW", "sb": "SB", "bw": "B&W",
}
SUMMARIES = {"max": "Max", "avg": "Avg"}
# --- fixed values: how the archive's files write dates ------------------------------
DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
    (r"^\d{8}$", "yyyyMMdd"),
]
PREFERRED = ["ps", "avg", "b365", "max"]
SERIES_LEVELS = {
    "grand slam": "G", "masters 1000": "M", "masters": "M", "masters cup": "F",
    "atp500": "A", "atp250": "A", "international gold": "A", "international": "A",
    "premier mandatory": "M", "premier m": "M", "premier": "M", "premier 5": "M",
    "wta1000": "M", "wta500": "A", "wta250": "A", "tier i": "M", "tier ii": "A",
    "tier iii": "A", "tier iv": "A", "tier v": "A", "grand prix": "A",
}


def series_level(series: Column) -> Column:
    return lookup(SERIES_LEVELS, F.lower(strip(series)), "A")


def court_is_indoor(court: Column) -> Column:
    return F.lower(strip(court)).startswith("indoor")


def completion(comment: Column) -> tuple[Column, Column]:
    text = F.lower(strip(comment))
    gone = text.startswith("walkover") | text.startswith("w/o") | text.startswith("disq")
    return known(text.startswith("retired")), known(gone)


def valid_price(value: Column) -> Column:
    price = number(value)
    return F.when((price > 1.0) & (price < 1000.0), price)


def price_date(text: Column) -> Column:
    """The date in any of the archive's formats, null otherwise."""
    clean = strip(text)
    return F.coalesce(
        F.to_date(F.try_to_timestamp(clean)),
        *[F.to_date(F.try_to_timestamp(F.when(clean.rlike(shape), clean), F.lit(form))) for shape, form in DATE_FORMATS])


def normalise(raw: DataFrame, tour: Column, undated: bool = False) -> DataFrame:
    """Any column may be absent; names match whatever their case. Rows without a date that can
    be read go, unless ``undated`` keeps them."""
    have = {c.strip().lower(): c for c in raw.columns}

    def column(*names: str) -> Column:
        for name in names:
            if name.lower() in have:
                return F.col(f"`{have[name.lower()]}`").cast("string")
        return F.lit(None).cast("string")

    retired, walkover = completion(column("comment"))
    columns = {
        "tour": F.lower(tour),
        "match_date": price_date(column("date")),
        "tournament": strip(column("tournament")), "location": strip(column("location")),
        "series": strip(column("series", "tier")),
        "level": series_level(column("series", "tier")),
        "indoor": court_is_indoor(column("court")),
        "surface": clean_surface(column("surface"), "Unknown"),
        "round": strip(column("round")), "best_of": whole(column("best of"), 3).cast("int"),
        "winner_name": strip(column("winner")), "loser_name": strip(column("loser")),
        "winner_rank": number(column("wrank")), "loser_rank": number(column("lrank")),
        "winner_rank_points": number(column("wpts")), "loser_rank_points": number(column("lpts")),
        **{f"{s}{n}": number(column(f"{s}{n}")) for n in range(1, 6) for s in ("w", "l")},
        "winner_sets": number(column("wsets")), "loser_sets": number(column("lsets")),
        "retirement": retired, "walkover": walkover, "comment": column("comment"),
    }
    for key, prefix in {**BOOKS, **SUMMARIES}.items():
        wanted = key in SUMMARIES or f"{prefix}w".lower() in have or f"{prefix}l".lower() in have
        if wanted:
            columns[f"odds_w_{key}"] = valid_price(column(f"{prefix}W"))
            columns[f"odds_l_{key}"] = valid_price(column(f"{prefix}L"))
    kept = ["_file"] if "_file" in raw.columns else []
    frame = raw.select(*[c.alias(n) for n, c in columns.items()], *kept)
    return frame if undated else frame.filter(F.col("match_date").isNotNull())


def best_price(frame: DataFrame) -> DataFrame:
    """The pair of the first preferred book that prices both sides."""
    order = PREFERRED + [b for b in BOOKS if b not in PREFERRED]
    options = []
    for book in order:
        if {f"odds_w_{book}", f"odds_l_{book}"} <= set(frame.columns):
            w, l = F.col(f"odds_w_{book}"), F.col(f"odds_l_{book}")
            options.append(F.when(w.isNotNull() & l.isNotNull(), F.struct(
                w.alias("w"), l.alias("l"), F.lit(book).alias("book"))))
    chosen = frame.withColumn("_best", F.coalesce(*options))
    return chosen.withColumns({
        "odds_winner": F.col("_best.w"), "odds_loser": F.col("_best.l"),
        "odds_book": F.col("_best.book")}).drop("_best")


def price_rows(frame: DataFrame) -> DataFrame:
    """Long form: one row per contest and book with a price on either side."""
    books = [b for b in {**BOOKS, **SUMMARIES} if f"odds_w_{b}" in frame.columns]
    pairs = F.array(*[
        F.struct(F.lit(b).alias("book"), F.col(f"odds_w_{b}").alias("odds_w"),
                 F.col(f"odds_l_{b}").alias("odds_l")) for b in books])
    keep = [c for c in frame.columns if not c.startswith("odds_")]
    rows = frame.select(*keep, F.inline(pairs))
    return rows.filter(F.col("odds_w").isNotNull() | F.col("odds_l").isNotNull())


def _united(spark, pattern: str, tour: str, undated: bool) -> DataFrame | None:
    out = None
    for raw in read_layouts(spark, pattern, ["winner"]):
        part = normalise(raw, F.lit(tour), undated)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def load(spark, pattern: str, tour: str) -> DataFrame | None:
    """Price files of several seasons, each read by its own header, in date order."""
    frame = _united(spark, pattern, tour, undated=False)
    return None if frame is None else frame.drop("_file").orderBy("match_date")


def load_report(spark, pattern: str, tour: str) -> DataFrame | None:
    """Rows of each file and how many of them have no date that can be read."""
    frame = _united(spark, pattern, tour, undated=True)
    return None if frame is None else frame.groupBy("_file").agg(
        F.count("*").alias("rows"), F.sum(F.col("match_date").isNull().cast("long")).alias("undated"))


def join_matches(matches: DataFrame, prices: DataFrame, days: int = 7) -> DataFrame:
    """Matches with the nearest price row of the same two players within ``days``.

    Days are bucketed, so a pair that met very often only meets its near rows.
    """
    size = days + 1
    left = matches.drop("odds_winner", "odds_loser").withColumn("_b", F.floor(day_number(F.col("match_date")) / size))
    right = prices.select(
        "tour", "winner_id", "loser_id", F.col("match_date").alias("price_date"),
        "odds_winner", "odds_loser",
        F.explode(F.array(*[
            F.floor(day_number(F.col("match_date")) / size) + d for d in (-1, 0, 1)])).alias("_b"))
    gap = F.abs(F.datediff("match_date", "price_date"))
    joined = left.join(right, ["tour", "winner_id", "loser_id", "_b"]).filter(gap <= days)
    nearest = F.struct(gap.alias("g"), F.col("price_date"), F.col("odds_winner"), F.col("odds_loser"))
    return joined.groupBy("match_id").agg(F.min(nearest).alias("n")).select(
        "match_id", "n.price_date", "n.odds_winner", "n.odds_loser")


def with_player_ids(prices: DataFrame, directory: DataFrame) -> DataFrame:
    """Adds ``winner_id`` and ``loser_id``: both published names resolved against the directory.

    ``prices`` has tour, winner_name, loser_name and optionally winner_rank, loser_rank; a name
    that is not found or not told apart gives null.
    """
    ranks = {s: F.col(f"{s}_rank") if f"{s}_rank" in prices.columns else F.lit(None).cast("double")
             for s in ("winner", "loser")}
    each = [prices.select("tour", F.col(f"{s}_name").alias("name"), ranks[s].alias("rank")) for s in ranks]
    resolved = via_table(names.resolve(each[0].unionByName(each[1]), directory), "price-names")
    for side, rank in ranks.items():
        told = resolved.select(F.col("tour").alias("_tour"), F.col("name").alias("_name"), F.col("rank").alias("_rank"),
                            F.col("player_id").alias(f"{side}_id"))
        prices = prices.join(told, (F.col("tour") == F.col("_tour")) & (F.col(f"{side}_name") == F.col("_name"))
                             & rank.eqNullSafe(F.col("_rank")), "left").drop("_tour", "_name", "_rank")
    return prices


def assign(matches: DataFrame, prices: DataFrame, days: int = 7) -> DataFrame:
    """One price row for a match and one match for a price row, nearest dates first.

    ``matches``: match_id, tour, winner_id, loser_id, match_date; ``prices`` the same with price_id
    in place of match_id. Returns match_id, price_id, gap. Of all pairs of rows of the same two
    players at most ``days`` apart the nearest is taken, then the nearest of those left, and so
    on; equal gaps go by match_id, then price_id. Pairs that are the nearest of both their rows
    are taken together, so the rounds are as many as rows compete in a chain, whatever their number.
    """
    size = days + 1
    day = day_number(F.col("match_date"))
    who = ["tour", "winner_id", "loser_id"]
    left = matches.select("match_id", *who, day.alias("day"), F.floor(day / size).alias("_b"))
    right = prices.select("price_id", *who, day.alias("price_day"), F.explode(F.array(*[
        F.floor(day / size) + d for d in (-1, 0, 1)])).alias("_b"))
    gap = F.abs(F.col("day") - F.col("price_day"))
    open_ = via_table(left.join(right, [*who, "_b"]).filter(gap <= days).select("match_id", "price_id", gap.alias("gap")),
                      "price-candidates")
    edge = F.struct("gap", "match_id", "price_id")
    taken = None
    while not open_.isEmpty():
        nearest = [open_.groupBy(key).agg(F.min(edge).alias("edge")).select("edge.*") for key in ("match_id", "price_id")]
        both = via_table(nearest[0].join(nearest[1], ["match_id", "price_id", "gap"]), "price-pairs")
        taken = both if taken is None else taken.unionByName(both)
        for key in ("match_id", "price_id"):
            open_ = open_.join(both.select(key), key, "left_anti")
        open_ = via_table(open_, "price-candidates")
    return open_ if taken is None else taken
