"""Screening of names against watchlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.arrays import contains_any, or_empty, present

from .checkpoints import written

#: Entries up to which a watchlist is compared with every distinct name.
SMALL_LIST = 200
#: Characters of names and entries that one part of a join holds, about.
BLOCK_CHARS = 1 << 22
#: Letters by which beginnings of texts are told apart, hashes of them, and places of a long text that are searched together.
START = 4
STARTS = 1 << 16
STRETCH = 256


def watched(spark: SparkSession) -> DataFrame:
    """The fixed entries as a watchlist: position, entry."""
    return spark.createDataFrame(list(enumerate(fixed.WATCHED_ENTITIES)), "position int, entry string")


def list_entries(watchlist: DataFrame) -> DataFrame:
    """position, entry of a watchlist (entry_id, name, aliases): names and aliases, in the order of the ids."""
    names = F.concat(F.array("name"), or_empty("aliases"))
    return watchlist.select(F.col("entry_id").alias("position"), F.explode(names).alias("entry"))


def short_entries(watchlist: DataFrame, small_list: int | None = None) -> F.Column | None:
    """A watchlist of up to ``small_list`` rows as an array of its entries (position, entry) in list order; None of a longer one."""
    small_list = SMALL_LIST if small_list is None else small_list
    rows = watchlist.select("position", F.lower("entry").alias("entry")).limit(small_list + 1).collect()
    if len(rows) > small_list:
        return None
    listed = sorted((r for r in rows if r.entry is not None), key=lambda r: (r.position is not None, r.position if r.position is not None else 0, r.entry))
    kind = f"array<struct<position: {watchlist.schema['position'].dataType.simpleString()}, entry: string>>"
    return F.array(*(F.struct(F.lit(r.position).alias("position"), F.lit(r.entry).alias("entry")) for r in listed)).cast(kind)


def meets_short(name: F.Column, listed: F.Column) -> F.Column:
    """Whether the name (lower case) has an entry of the list, as in first_of_short."""
    return F.exists(listed, lambda e: F.contains(name, e["entry"]) | F.contains(e["entry"], name))


def first_of_short(name: F.Column, listed: F.Column) -> F.Column:
    """The first of the listed entries that the name (lower case) holds or is part of, else null."""
    return F.get(F.filter(listed, lambda e: F.contains(name, e["entry"]) | F.contains(e["entry"], name)), F.lit(0))


def first_entries(parties: DataFrame, watchlist: DataFrame, small_list: int = SMALL_LIST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """name (lower case) and m (position, entry) of the distinct party names that match a watchlist entry.

    Either is part of the other; the first in list order counts, of equal positions
    the first text.  Null names and entries match nothing.  A list of up to
    ``small_list`` rows is broadcast and compared with every name.  A longer one is
    met by equal pieces (first_by_pieces), in parts of about ``block_chars`` characters.
    """
    names = parties.select(F.lower("party").alias("name")).where("name IS NOT NULL").distinct()
    entries = watchlist.select("position", F.lower("entry").alias("entry")).where("entry IS NOT NULL")
    if watchlist.limit(small_list + 1).count() > small_list:
        return first_by_pieces(names, entries, block_chars)
    either = F.contains("name", F.col("entry")) | F.contains(F.col("entry"), F.col("name"))
    return names.join(F.broadcast(entries), either).groupBy("name").agg(F.min(F.struct("position", "entry")).alias("m"))


def first_by_pieces(names: DataFrame, entries: DataFrame, block_chars: int) -> DataFrame:
    """name and m (position, entry) of names with an entry that they hold or that holds them.

    Pieces of the names are joined to the entries that they are, and pieces of the entries,
    each with its first entry only, to the names.  Between the two only the numbers
    of names and the ranks of entries are carried, so what is shuffled grows as names and list do.
    """
    names = written(names.withColumn("id", F.monotonically_increasing_id()))
    # After a sort the ids are in the order of the list.
    entries = entries.groupBy("entry").agg(F.min("position").alias("position")).orderBy("position", "entry")
    entries = written(entries.withColumn("rank", F.monotonically_increasing_id()))
    chars = sum(df.agg(F.sum(F.length(c).cast("long") + 1)).first()[0] or 0 for df, c in ((names, "name"), (entries, "entry")))
    parts = max(1, -(-chars // block_chars))

    def met(pieces: DataFrame, texts: DataFrame, column: str, number: str) -> DataFrame:
        texts = texts.select(F.col(column).alias("piece"), number)
        return pieces.repartition(parts, "piece").join(texts.repartition(parts, "piece"), "piece").select("id", "rank")

    held = met(pieces_like(names, "name", "id", entries, "entry"), entries, "entry", "rank")
    holding = pieces_like(entries.repartition(parts, "rank"), "entry", "rank", names, "name").groupBy("piece").agg(F.min("rank").alias("rank"))
    first = held.unionByName(met(holding, names, "name", "id")).groupBy("id").agg(F.min("rank").alias("rank"))
    return first.join(entries, "rank").join(names, "id").select("name", F.struct("position", "entry").alias("m"))


def pieces_like(texts: DataFrame, column: str, number: str, listed: DataFrame, like: str) -> DataFrame:
    """piece, number: the pieces of the texts that are as long as a listed text and, by a hash of ``START`` letters, begin as it does.

    The lengths of the listed texts of each beginning are broadcast, so a place of a text where none begins
    gives no piece.  Long texts are cut into stretches of places first.
    """
    def start(text: F.Column, at: F.Column, width: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(F.substring(text, at, width)), F.lit(STARTS))

    own, width = F.length(like), F.least(F.length(like), F.lit(START))
    begun = listed.groupBy(width.alias("width"), start(F.col(like), F.lit(1), F.lit(START)).alias("start"))
    kinds = written(begun.agg(F.collect_set(own).alias("lengths")))
    widths, longest = kinds.agg(F.collect_set("width"), F.max(F.array_max("lengths"))).first()
    stretches = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length({column}) - 1) div {STRETCH}").cast("int"))))
    cut = texts.select(number, column, stretches.alias("nth")).select(
        number, "nth", F.substring(column, F.col("nth") * STRETCH + 1, F.lit(STRETCH + (longest or 0))).alias("text"),
        F.explode(F.array(*(F.lit(w) for w in widths)).cast("array<int>")).alias("width"),
    )
    # The empty text is found once, all others wherever there is room.
    cut = cut.where("length(text) >= width AND (width > 0 OR nth = 0)")
    last = F.when(F.col("width") == 0, 1).otherwise(F.least(F.lit(STRETCH), F.length("text") - F.col("width") + 1))
    placed = cut.select(number, "text", "width", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    found = placed.withColumn("start", start(F.col("text"), F.col("at"), F.col("width"))).join(F.broadcast(kinds), ["width", "start"])
    found = found.select(number, "text", "at", F.explode("lengths").alias("n")).where("at + n - 1 <= length(text)")
    return found.select(F.substring("text", F.col("at"), F.col("n")).alias("piece"), number)


def sanctions_screen(tx: DataFrame, watchlist: DataFrame, min_len: int = 0) -> DataFrame:
    """One row per transaction, party position and hit: tx_id, nth, party, entry, match_type, confidence.

    A party and an entry match if either is part of the other, in lower case;
    of several entries the first in list order counts.  An empty party is part
    of everything: ``min_len`` keeps short parties out.

    Distinct names only meet the list, which may be of any length (first_entries).
    """
    parties = tx.select("tx_id", F.posexplode(or_empty("parties")).alias("nth", "party")).where(F.length("party") >= min_len)
    hits = parties.join(first_entries(parties, watchlist), F.lower("party") == F.col("name"))
    exact = F.col("m.entry") == F.col("name")
    return hits.select(
        "tx_id", "nth", "party", F.col("m.entry").alias("entry"),
        F.when(exact, "EXACT").otherwise("PARTIAL").alias("match_type"), F.when(exact, 0.95).otherwise(0.75).alias("confidence"),
    )


def country_sanctions_screen(tx: DataFrame) -> DataFrame:
    """Hits of the kind JURISDICTION: parties named after a sanctioned origin's countries."""
    parties = tx.where(F.col("origin_country").isin(*fixed.SANCTIONED_ORIGINS)).select(
        "tx_id", F.posexplode(or_empty("parties")).alias("nth", "party")
    )
    return parties.where(contains_any(F.lower("party"), fixed.SANCTIONED_ORIGIN_WORDS)).select(
        "tx_id", "nth", "party", F.lit(None).cast("string").alias("entry"), F.lit("JURISDICTION").alias("match_type"), F.lit(0.8).alias("confidence")
    )


def sanctioned(name: F.Column, origin: F.Column) -> F.Column:
    """Whether a name (lower case) from a sanctioned origin is named after such a country."""
    return origin.isin(*fixed.SANCTIONED_ORIGINS) & contains_any(name, fixed.SANCTIONED_ORIGIN_WORDS)


def hits_of(party: F.Column, m: F.Column, nth: F.Column, origin: F.Column) -> F.Column:
    """The hits of one party: that on the list (m: position, entry), then that by country."""
    exact = m["entry"] == F.lower(party)

    def hit(late: int, kind: F.Column, confidence: F.Column) -> F.Column:
        return F.struct(nth.alias("nth"), F.lit(late).alias("late"), party.alias("party"), kind.alias("match_type"), confidence.alias("confidence"))

    on_list = hit(0, F.when(exact, "EXACT").otherwise("PARTIAL"), F.when(exact, 0.95).otherwise(0.75))
    by_country = hit(1, F.lit("JURISDICTION"), F.lit(0.8))
    return present(F.when(m.isNotNull(), on_list), F.when(sanctioned(F.lower(party), origin), by_country))


def slim(hits: F.Column) -> F.Column:
    return F.transform(hits, lambda h: F.struct(h["party"].alias("party"), h["match_type"].alias("match_type"), h["confidence"].alias("confidence")))


def hit_lists(tx: DataFrame, watchlist: DataFrame) -> DataFrame:
    """tx_id and sanction_hits (party, match_type, confidence) of transactions with hits.

    Hits are in party order, a party's list hit before its country hit.  The
    parties are read once for their distinct names and once for the hits; only
    rows with hits are grouped.
    """
    parties = tx.select("tx_id", "origin_country", F.posexplode(or_empty("parties")).alias("nth", "party"))
    found = parties.join(first_entries(parties, watchlist), F.lower("party") == F.col("name"), "left")
    hits = hits_of(F.col("party"), F.col("m"), F.col("nth"), F.col("origin_country"))
    grouped = found.select("tx_id", hits.alias("h")).where(F.size("h") > 0).groupBy("tx_id").agg(F.sort_array(F.flatten(F.collect_list("h"))).alias("h"))
    return grouped.select("tx_id", slim(F.col("h")).alias("sanction_hits"))


def with_hits(tx: DataFrame, watchlist: DataFrame) -> DataFrame:
    """tx with sanction_hits as in hit_lists, empty where there are none.

    With a short list a row's hits are read from its own parties, so nothing is shuffled
    and a name that very many have is no key.  The hits of a long list are joined.
    """
    listed = short_entries(watchlist)
    if listed is None:
        none = F.array().cast("array<struct<party: string, match_type: string, confidence: double>>")
        return tx.join(hit_lists(tx, watchlist), "tx_id", "left").withColumn("sanction_hits", F.coalesce("sanction_hits", none))
    parties = or_empty("parties")
    named = F.arrays_zip(parties.alias("party"), F.transform(parties, lambda p: F.lower(p)).alias("name"))
    # Most parties are in no hit and go no further.
    met = F.filter(named, lambda x: meets_short(x["name"], listed) | sanctioned(x["name"], F.col("origin_country")))
    hits = F.transform(met, lambda x: hits_of(x["party"], first_of_short(x["name"], listed), F.lit(0), F.col("origin_country")))
    hits = F.flatten(hits)  # in party order
    return tx.withColumn("sanction_hits", slim(hits))


def active_entries(entries: DataFrame, as_of: str) -> DataFrame:
    """Entries in force: active, added by then, and not removed by then."""
    now = F.to_timestamp(F.lit(as_of))
    return entries.where(
        F.col("is_active")
        & (F.col("added_date").isNull() | (F.col("added_date") <= now))
        & (F.col("removed_date").isNull() | (F.col("removed_date") > now))
    )


def flagged(customers: DataFrame, hits: DataFrame, key: str = "customer_id") -> DataFrame:
    return customers.join(hits.select(key), key, "left_semi")


def clean(customers: DataFrame, hits: DataFrame, key: str = "customer_id") -> DataFrame:
    return customers.join(hits.select(key), key, "left_anti")


def fuzzy_screen(parties: DataFrame, watchlist: DataFrame, threshold: float = 0.75, gram: int = 3, use_soundex: bool = False) -> DataFrame:
    """The best entry of every distinct party name: party, entry_id, matched_name, how, similarity.

    Names and aliases are compared by 1 - edits / longer length; no pair of at
    least ``threshold``, which must be over a half, is lost.  With ``use_soundex``
    names that sound alike count, too.  Distinct names meet by the rarest of their pieces
    (pairs_by_pieces) or, where those can't decide, by segments (pairs_by_segments).
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("a threshold over 0.5, up to 1, is needed: half-alike names need not share a letter in place")
    names = parties.select(F.lower(F.trim("party")).alias("party")).where("party <> ''").distinct()
    every = watchlist.select(
        "entry_id", F.explode(F.concat(F.array(F.struct(F.col("name").alias("n"), F.lit("name").alias("how"))),
                                       F.transform(or_empty("aliases"), lambda a: F.struct(a.alias("n"), F.lit("alias").alias("how"))))).alias("x"),
    ).select("entry_id", F.lower(F.trim("x.n")).alias("name"), "x.how").where("name <> ''")
    listed = every.select("name").distinct()
    if threshold >= 1 - 1 / gram:
        pieces = pieces_of(names, listed, threshold, gram)
        pairs = pairs_by_pieces(pieces, threshold)
        # Names whose pieces repeat so much that all may be spoiled.
        few = [pieces.where("few").select(F.col("text").alias(c)).distinct() for c in ("party", "name")]
        few = [own.join(df, c, "left_semi") for own, df, c in zip((names, listed), few, ("party", "name"), strict=True)]
        pairs = pairs.unionByName(pairs_by_segments(*few, threshold))
    else:
        pairs = pairs_by_segments(names, listed, threshold)
    if use_soundex:
        by_sound = names.withColumn("s", F.soundex("party")).join(listed.withColumn("s", F.soundex("name")), "s")
        pairs = pairs.unionByName(by_sound.select("party", "name"))
    longer = F.greatest(F.length("party"), F.length("name"))
    similarity = F.round(1 - F.levenshtein("party", "name") / longer, 6)
    scored = pairs.distinct().withColumn("similarity", similarity)
    sounds = F.soundex("party") == F.soundex("name") if use_soundex else F.lit(False)
    best = scored.where((F.col("similarity") >= threshold) | sounds).join(every, "name")
    first = Window.partitionBy("party").orderBy(F.desc("similarity"), "entry_id", F.desc("how"), "name")
    return (
        best.withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
        .select("party", "entry_id", F.col("name").alias("matched_name"), "how", "similarity")
    )


def share(threshold: float) -> float:
    """The part of the longer name that may be edited; similarities are rounded to six places."""
    return 1 - threshold + 1e-6


def pieces_of(names: DataFrame, listed: DataFrame, threshold: float, gram: int) -> DataFrame:
    """The join keys of party names and of listed ones: text, is_party, length, few, piece, at, once.

    A padded name's distinct pieces of ``gram`` letters are put in order from the
    rarest among all names to the most frequent.  An edit spoils at most ``gram`` of
    them, so of the first gram x edits + 1 a similar name has one, too: only those are kept.
    ``at`` is the piece's first place, ``once`` whether it has no other; ``few``
    are names with no more pieces than edits can spoil.
    """
    texts = names.select(F.col("party").alias("text"), F.lit(True).alias("is_party")).unionByName(listed.select(F.col("name").alias("text"), F.lit(False).alias("is_party")))
    padded = F.concat(F.lit("^" * (gram - 1)), F.col("text"), F.lit("$" * (gram - 1)))
    places = F.sequence(F.lit(1), F.length(padded) - gram + 1)
    dealt = texts.select("text", "is_party", F.explode(F.transform(places, lambda i: F.struct(F.substring(padded, i, gram).alias("piece"), i.alias("at")))).alias("p"))
    own = dealt.groupBy("text", "is_party", "p.piece").agg(F.min("p.at").alias("at"), (F.count("*") == 1).alias("once"))
    rarity = own.groupBy("piece").agg(F.count("*").alias("names"))
    ranked = own.join(rarity, "piece").groupBy("text", "is_party").agg(F.sort_array(F.collect_list(F.struct("names", "piece", "at", "once"))).alias("p"))
    d = share(threshold)
    edits = F.floor(F.length("text") / (1 - d) * d)  # against the longest name that may be similar
    kept = gram * edits + 1
    return ranked.select(
        "text", "is_party", F.length("text").alias("length"), (F.size("p") < kept).alias("few"), F.explode(F.slice("p", F.lit(1), kept.cast("int"))).alias("k")
    ).select("text", "is_party", "length", "few", "k.piece", "k.at", "k.once")


def pairs_by_pieces(pieces: DataFrame, threshold: float) -> DataFrame:
    """party, name: pairs with one of their rarest pieces in common, near the same place where it has one place only."""
    left = pieces.where("is_party").select("piece", F.col("text").alias("party"), F.col("length").alias("l"), F.col("at").alias("l_at"), F.col("once").alias("l_once"))
    right = pieces.where("NOT is_party").select("piece", F.col("text").alias("name"), F.col("length").alias("r"), F.col("at").alias("r_at"), F.col("once").alias("r_once"))
    edits = F.floor(F.greatest("l", "r") * share(threshold))
    near = ~(F.col("l_once") & F.col("r_once")) | (F.abs(F.col("l_at") - F.col("r_at")) <= edits)
    return left.join(right, "piece").where((F.abs(F.col("l") - F.col("r")) <= edits) & near).select("party", "name").distinct()


def pairs_by_segments(names: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """party, name: pairs that share a segment.

    For each length a similar party may have, a listed name is cut into one segment more
    than there may be edits, so one of them is in the party unchanged, and no
    further from its place than the edits on either side allow.  Keys are both
    lengths, the segment's number and its letters.
    """
    d = share(threshold)
    lengths = lambda c: F.sequence(F.greatest(F.lit(1), F.ceil(F.length(c) * (1 - d) - 1e-9)).cast("int"), F.floor(F.length(c) / (1 - d) + 1e-9).cast("int"))
    edits = F.floor(F.greatest("l", "r") * d).cast("int")
    cut = {
        "base": F.expr("r div (edits + 1)"), "rest": F.expr("r % (edits + 1)"),
    }
    begin = F.expr("segment * base + greatest(0, segment - (edits + 1 - rest))")
    size = F.expr("base + IF(segment >= edits + 1 - rest, 1, 0)")

    def cut_up(df: DataFrame) -> DataFrame:
        allowed = df.withColumn("edits", edits).where(F.abs(F.col("l") - F.col("r")) <= F.col("edits"))
        numbered = allowed.withColumns(cut).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("edits"))))
        return numbered.withColumn("begin", begin.cast("int")).withColumn("size", size.cast("int"))

    right = cut_up(listed.select("name", F.length("name").alias("r"), F.explode(lengths("name")).alias("l")))
    right = right.select("name", "l", "r", "segment", F.expr("substring(name, begin + 1, size)").alias("letters"))
    left = cut_up(names.select("party", F.length("party").alias("l"), F.explode(lengths("party")).alias("r")))
    low, high = F.expr("begin - (edits - (l - r)) div 2"), F.expr("begin + (edits + (l - r)) div 2")
    at = F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.expr("l - size")).cast("int")))
    left = left.where(F.greatest(low, F.lit(0)) <= F.least(high, F.expr("l - size"))).withColumn("at", at)
    left = left.select("party", "l", "r", "segment", F.expr("substring(party, at + 1, size)").alias("letters")).distinct()
    return left.join(right, ["l", "r", "segment", "letters"]).select("party", "name").distinct()
