"""Labelled pairs: corrupted positives, hard negatives by blocking, all seeded by hashes of keys, so that any run makes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import codes
from tessera.functions.text import let
from tessera.sources.scratch import stored


def sample(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones each time."""
    order = F.xxhash64(*keys, F.lit(seed))
    return df.orderBy(order, *keys).limit(n)


def _draw(n: Column | int, *seeds: Column | str | int) -> Column:
    """0 .. n-1 from a hash."""
    return F.pmod(F.xxhash64(*(s if isinstance(s, Column) else F.lit(s) for s in seeds)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def format_variant(c: Column, key: Column) -> Column:
    """One of the variants by case and spaces that differ from the text; the text itself if none does."""
    every = F.array(F.upper(c), F.lower(c), F.replace(c, F.lit(" "), F.lit("  ")), F.replace(c, F.lit(","), F.lit(" ,")), F.trim(c))
    other = F.filter(every, lambda v: v != c)
    return F.coalesce(F.get(other, _draw(F.greatest(F.size(other), F.lit(1)), key, "variant")), c)


def typo(c: Column, key: Column, salt: str = "typo") -> Column:
    """Swaps, drops or doubles one inner character; texts below four characters stay."""

    def spoilt(x: Column) -> Column:
        n = F.length(x)
        at = _draw(F.greatest(n - 3, F.lit(1)), key, salt, "at") + 2
        head, a, b, tail = F.substring(x, F.lit(1), at - 1), F.substring(x, at, F.lit(1)), F.substring(x, at + 1, F.lit(1)), F.substring(x, at + 2, n)
        kind = _draw(3, key, salt, "kind")
        return F.when(n < 4, x).when(kind == 0, F.concat(head, b, a, tail)).when(kind == 1, F.concat(head, b, tail)).otherwise(F.concat(head, a, a, b, tail))

    return let(c, spoilt)


def typos(c: Column, key: Column) -> Column:
    """One or two of them."""
    return let(typo(c, key, "first"), lambda once: F.when(_draw(2, key, "twice") == 0, once).otherwise(typo(once, key, "second")))


def corrupt_street(c: Column, key: Column) -> Column:
    """Lower case; seven in ten get typos, half two words swapped; the first rua and avenida are abbreviated."""

    def swap(bad: Column) -> Column:
        words = F.split(bad, " ")
        at = _draw(F.greatest(F.size(words) - 1, F.lit(1)), key, "swap at")
        swapped = F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.get(words, at + 1)).when(i == at + 1, F.get(words, at)).otherwise(w)), " ")
        return F.when((F.size(words) > 2) & (_draw(2, key, "swap") == 0), swapped).otherwise(bad)

    low = F.lower(c)
    mixed = let(F.when((F.length(low) > 10) & (_draw(10, key, "typos") < 7), typos(low, key)).otherwise(low), swap)
    return F.regexp_replace(F.regexp_replace(mixed, r"^(.*?)rua", "$1r"), r"^(.*?)avenida", "$1av")


def positives(rows: DataFrame, key: str, street: str, number: str, city: str, postcode: str) -> DataFrame:
    """Pairs of one address as it is and attacked: street corrupted, city or postcode left out; unchanged ones are dropped."""
    k = F.col(key)
    line = lambda *c: F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in c))
    s, n, ci, p = (F.col(x).cast("string") for x in (street, number, city, postcode))
    kind = _draw(4, k, "attack")
    attacked = let(corrupt_street(s, k), lambda bad: F.when(kind == 0, line(bad, n, ci, p)).when(kind == 1, line(s, n, p)).when(kind == 2, line(s, n, ci)).otherwise(line(bad, n, ci)))
    return rows.select(k.alias("pair_id"), line(s, n, ci, p).alias("address_1"), attacked.alias("address_2"), F.lit(1).alias("label")).where("address_1 <> address_2")


#: Bits of the hash that order a split's rows into ranges.
BUCKET_BITS = 12
#: Texts of a block that one row is compared with at a time.
CHUNK = 256
#: Texts asked at first for each of the first hard negatives wanted; tasks a core that their chunks are dealt to.
AHEAD, TASKS = 2, 4


def hard_negatives(rows: DataFrame, block: str, text: str, score: Callable[[Column, Column], Column], low: float, high: float, least_rows: int = 1, by_row: bool = False) -> DataFrame:
    """Within each block of more than ``least_rows`` rows, each text's most similar other one, if low <= its score < high; ties by text.

    The best of all others is asked for, so each text meets all texts of its block, but in chunks that are reduced in place: a text makes a row for each
    CHUNK of them, not for each. ``by_row``: ``score`` can't stand in a lambda (a Python function); chunks are then unfolded for it
    and reduced before the shuffle.
    """
    return _best_others(*_blocked(rows, block, text, least_rows), block, score, low, high, by_row)


def _blocked(rows: DataFrame, block: str, text: str, least_rows: int) -> tuple[DataFrame, DataFrame]:
    """Different texts (block, a) of blocks that have several, and the same as chunks (block, _b)."""
    sizes = rows.groupBy(block).agg(F.count("*").alias("_rows"), F.count_distinct(text).alias("_texts")).where((F.col("_rows") > least_rows) & (F.col("_texts") > 1)).select(block, F.ceil(F.col("_texts") / CHUNK).alias("_chunks"))
    texts = rows.select(block, F.col(text).alias("a")).where("a is not null").distinct().join(sizes, block)
    chunks = texts.groupBy(block, F.pmod(F.xxhash64("a"), F.col("_chunks")).alias("_chunk")).agg(F.collect_list("a").alias("_b")).select(block, "_b")
    return texts.select(block, "a"), chunks


def _best_others(texts: DataFrame, chunks: DataFrame, block: str, score: Callable[[Column, Column], Column], low: float, high: float, by_row: bool, tasks: int = 0) -> DataFrame:
    met = texts.select(block, "a").join(chunks, block)
    met = met.repartition(tasks) if tasks else met
    best = lambda s, b: F.struct((-s).alias("s"), b.alias("b"))
    if by_row:
        each = met.select(block, "a", F.explode("_b").alias("b")).where("a <> b").select(block, "a", best(score(F.col("a"), F.col("b")), F.col("b")).alias("_best"))
    else:
        others = F.filter("_b", lambda b: b != F.col("a"))
        each = met.select(block, "a", F.array_min(F.transform(others, lambda b: best(score(F.col("a"), b), b))).alias("_best"))
    first = each.groupBy(block, "a").agg(F.min("_best").alias("_best")).select(block, F.col("a").alias("left"), F.col("_best.b").alias("right"), (-F.col("_best.s")).alias("score"))
    return first.where((F.col("score") >= low) & (F.col("score") < high))


def first_hard_negatives(rows: DataFrame, block: str, text: str, score: Callable[[Column, Column], Column], low: float, high: float, n: int, order: Callable[[str, str], tuple[Column, Column]], least_rows: int = 1) -> DataFrame:
    """Those hard_negatives() that are the first n by ``order`` of (block, left), two longs, and maybe some more; all if there are fewer. ``score`` goes by row.

    Which texts come first does not depend on scores, so texts are asked in that order, four times as many each time, until n have a hard negative or all are
    asked. Each that is asked meets all others of its block.
    """
    texts, chunks = (stored(x) for x in _blocked(rows, block, text, least_rows))
    key = lambda a, b: F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    left = texts.withColumn("_order", key(*order(block, "a")))
    tasks = texts.sparkSession.sparkContext.defaultParallelism * TASKS
    found, many = None, AHEAD * n
    while True:
        upto = left.select("_order").orderBy("_order").limit(many).agg(F.max("_order").alias("o"), F.count("*").alias("n")).first()
        if not upto.n and found is not None:
            return found
        # Rows at the bound are asked with it, all of them.
        bound = key(F.lit(upto.o.x), F.lit(upto.o.y)) if upto.n else None
        asked = left.where(F.col("_order") <= bound) if upto.n else left
        part = stored(_best_others(asked, chunks, block, score, low, high, True, tasks))
        found = part if found is None else found.unionByName(part)
        if upto.n < many or found.count() >= n:
            return found
        left, many = left.where(F.col("_order") > bound), 4 * many


def fuzzy_percent(a: Column, b: Column) -> Column:
    return codes.on_pairs(codes.weighted_ratio, "int")(a, b).cast("double")


def same_text_other_block(rows: DataFrame, block: str, text: str) -> DataFrame:
    """For each text in several blocks, its first two blocks: same street, other city."""
    each = rows.where(F.col(text).isNotNull() & F.col(block).isNotNull()).groupBy(text).agg(F.sort_array(F.collect_set(block)).alias("_b")).where(F.size("_b") > 1)
    return each.select(text, F.get("_b", 0).alias("block_1"), F.get("_b", 1).alias("block_2"))


def random_negatives(rows: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """Each text with another one: rows in hash order, each with the next of its hash bucket; no cross product."""
    order = F.xxhash64(key, F.lit(seed))
    w = Window.partitionBy(F.pmod(order, F.lit(1024))).orderBy(order, key)
    return rows.select(F.col(key).alias("pair_id"), F.col(text).alias("address_1"), F.lead(text).over(w).alias("address_2"), F.lit(0).alias("label")).where("address_2 is not null and address_1 <> address_2")


def pair_order(pair_id: Column) -> tuple[Column, Column]:
    return F.xxhash64(pair_id, F.lit(42)), pair_id


def balanced(positive: DataFrame, hard: DataFrame, random: DataFrame, n: int) -> DataFrame:
    """n pairs of each label: hard negatives first, then random ones; in hash order. All with pair_id, address_1, address_2, label."""
    pos = sample(positive, n, "pair_id", "address_2")
    neg = hard.withColumn("_order", F.lit(0)).unionByName(random.withColumn("_order", F.lit(1)))
    neg = neg.orderBy("_order", *pair_order(F.col("pair_id"))).limit(n).drop("_order")
    return pos.unionByName(neg)


def stratified_split(rows: DataFrame, label: str, *keys: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``rows`` with ``train``: of each label exactly the share, rounded up, by hash order.

    Rows are ranked within BUCKETS ranges of the hash, whose sizes say how many come before; so no label is one task's work.
    """
    order = F.xxhash64(*keys, F.lit(seed))
    each = rows.withColumn("_bucket", F.shiftrightunsigned(order, 64 - BUCKET_BITS).cast("long"))
    sizes = each.groupBy(label, "_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    known = sizes.select(F.col(label).alias("_label"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(label)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy(F.shiftrightunsigned(order, 1), order, *keys))
    ranked = each.withColumn("_rank", rank).join(known, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b")))
    return ranked.select(*rows.columns, (F.col("_before") + F.col("_rank") <= F.ceil(F.col("_n") * share)).alias("train"))


#: Sets of up to so many tokens meet by two tokens.
MANY = 16


def _meetings(ordered: DataFrame, least: float) -> DataFrame:
    """Pairs of sets (k, s), tokens in one order by rarity, that share what the similarity asks of their first tokens: (t, u), u < 0 where it is one token."""
    n = F.size("s")
    shared = lambda size: F.ceil(size * least - 1e-9)
    # A token met once is in no other set, but stands in the order all the same; it has no partner in the join.
    head = lambda more: F.slice("s", F.lit(1), (n - shared(n) + more).cast("int"))
    entry = lambda t, u, at: F.struct(t.alias("t"), u.alias("u"), at.alias("at"))
    ones = F.transform(head(1), lambda t, at: entry(t, F.lit(-1).cast("long"), at))
    twos = F.flatten(F.transform(head(2), lambda t, at: F.transform(F.slice(head(2), at + 2, n), lambda u: entry(t, u, at))))
    none = F.slice(ones, 1, 0)
    keys = F.concat(F.when((shared(n) < 2) | (n >= F.lit(least * MANY - 1e-9)), ones).otherwise(none), F.when((n >= 2) & (n <= MANY), twos).otherwise(none))
    prefix = ordered.select("k", "s", n.alias("n"), F.explode(keys).alias("_e")).select("k", "s", "n", "_e.*")
    other = prefix.select("t", "u", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("s").alias("s2"))
    need = F.lit(least - 1e-9) / (1 + least) * (F.col("n") + F.col("n2"))
    large = F.greatest("n", "n2")
    met = prefix.join(other, ["t", "u"]).where((F.col("k") < F.col("k2")) & (F.least("n", "n2") >= F.lit(least - 1e-9) * large) & (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= need))
    return met.where((F.col("u") >= 0) == ((shared(large) >= 2) & (large <= MANY)))


def jaccard_join(left: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """Pairs of rows whose token sets have that Jaccard similarity: rare tokens first, prefix join, verified once per pair of different sets.

    Rows of equal sets go as one, by their smallest key, until pairs are known, and make pairs with each other unseen.
    Sets are put in order of their tokens' frequency by sorting arrays of (frequency, token), not by ranking rows. Where two tokens must be shared, sets of
    up to MANY tokens meet by two of a prefix that is one longer, which far fewer sets share than one of it.
    """
    rows = stored(left.select(F.col(key).alias("row"), F.sort_array(F.array_distinct(tokens)).alias("s")).where(F.size("s") > 0))
    sets = rows.groupBy("s").agg(F.min("row").alias("k"))
    of = rows.join(sets, "s").select("k", "row")
    of2 = of.toDF("k2", "row2")
    each = sets.select("k", F.explode("s").alias("t"))
    numbered = stored(each.groupBy("t").agg(F.count("*").alias("df")).withColumn("id", F.monotonically_increasing_id()))
    ordered = stored(each.join(numbered, "t").groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "id"))), lambda x: x["id"]).alias("s")))
    met = _meetings(ordered, least)
    common = F.array_intersect("s", "s2")
    # Of the prefix tokens that two sets share, the first ones stand for the pair.
    once = met.where((F.get(common, 0) == F.col("t")) & ((F.col("u") < 0) | (F.get(common, 1) == F.col("u"))))
    score = F.size(common) / (F.col("n") + F.col("n2") - F.size(common))
    similar = once.select("k", "k2", score.alias("similarity")).where(F.col("similarity") >= least)
    apart = similar.join(of, "k").join(of2, "k2").select(F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b"), "similarity").where("a <> b")
    equal = of.join(of2, (F.col("k") == F.col("k2")) & (F.col("row") < F.col("row2"))).select("row", "row2", F.lit(1.0))
    return apart.unionAll(equal).toDF(f"{key}_1", f"{key}_2", "similarity")
