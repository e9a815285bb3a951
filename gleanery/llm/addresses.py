"""Address records that denote the same place although written differently.

1. Each address is parsed into postcode, region, town, street or quarter, kind
   of street and house number (Japanese, romanised and Latin forms).
2. A gazetteer learnt from all rows (the usual town and street of a postcode,
   the usual region of a town) fills missing parts.
3. Candidates share the house number and either the postcode or the town with a
   sound key of the street, which a doubled, lost, added, changed or swapped
   letter leaves in common.
4. Candidates are compared part by part, with a level of agreement for "missing
   on one side". Chance agreement (u) comes from the value frequencies of all
   rows, agreement within matches (m) and the share of matches from expectation
   maximisation over the counts of comparison patterns.
5. Spellings linked with enough weight form places; records of one place pair.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pairs_of_groups, ship
from .skeleton import CYRILLIC, DASHES, GREEK, INVISIBLE

#: Posterior probability from which two spellings are one place.
MATCH_FROM = 0.9
EM_ROUNDS = 50
MAX_ROUNDS = 30

# Variants of ideographs in place names, and kinds of street with their abbreviations.
IDEOGRAPHS = "髙高 﨑崎 嵜崎 澤沢 濱浜 嶋島 嶌島 龍竜 瀧滝 邊辺 邉辺 櫻桜 廣広 國国 圓円 瀨瀬 鷄鶏 峯峰 埜野 冨富 藪薮"
STREETS = {
    "street": "street st str", "road": "road rd", "avenue": "avenue ave av", "square": "square sq", "gardens": "gardens garden gdns gdn", "lane": "lane ln", "court": "court ct crt",
    "terrace": "terrace terr ter", "close": "close cl", "place": "place pl", "drive": "drive dr", "crescent": "crescent cres", "way": "way", "hill": "hill", "row": "row", "walk": "walk", "grove": "grove gr", "park": "park pk", "mews": "mews",
}
KANJI_DIGITS = "一二三四五六七八九"

_KIND = {a: k for k, v in STREETS.items() for a in v.split()}
_FOLD = {ord(p[0]): p[1] for p in f"{CYRILLIC} {GREEK} {IDEOGRAPHS}".split(" ")} | {int(c, 16): "" for c in INVISIBLE.split()}
_DASH = {int(c, 16): "-" for c in DASHES.split() if c not in ("30fc", "ff70")}
_N = r"(?:\d+|[一二三四五六七八九十]+)"
_JP = re.compile(rf"^(?:〒?(\d{{3}})-?(\d{{4}}))?(?:日本)?([^\d]{{1,4}}?[都道府県])?([^\d市区町村郡]区|[^\d市区町村郡]市(?![^\d]{{1,3}}区)|[^\d]{{2,5}}?[市区町村郡])?([^\d]*?)(?:({_N})(?:丁目|-))?(\d+)(?:番地の?|番|-|の)(\d+)号?(.*)$")
_ROMAJI = re.compile(r"(?<![\d-])(\d+)-(\d+)-(\d+)(?![\d-])")
_ZIP = re.compile(r"(?<!\d)(\d{3})-(\d{4})(?!\d)")
_POST = re.compile(r"\b([a-z]{1,2}\d{1,2}[a-z]?)\s?(\d{1,2}[a-z]{2})\b")
_LEVEL = re.compile(r"\b(?:(?:ground|first|second|third|fourth|top|basement|\d+(?:st|nd|rd|th)?)\s+floor|(?:flat|unit|apt|apartment|suite|room|floor)\.?\s+\w+)\b")
_KIND_WORD = re.compile(r"\s(" + "|".join(sorted(map(re.escape, _KIND), key=len, reverse=True)) + r")\b\.?")
_DELIMITERS = "0123456789,/()"
# Kinds of street of other languages, as endings and as words before the name.
ENDINGS = {"strasse": "straße strasse str", "weg": "weg", "gasse": "gasse", "platz": "platz", "allee": "allee", "ring": "ring", "damm": "damm", "ufer": "ufer"}
LEADING = {"rue": "rue", "avenue": "avenue av", "place": "place pl", "boulevard": "boulevard bd blvd", "chemin": "chemin ch", "quai": "quai", "impasse": "impasse", "calle": "calle c/", "avenida": "avenida avda av", "plaza": "plaza pza", "paseo": "paseo pso", "camino": "camino", "via": "via", "piazza": "piazza"}
_ENDING = [(a, k) for k, v in ENDINGS.items() for a in sorted(v.split(), key=len, reverse=True)]
_LEADING = {a: k for k, v in LEADING.items() for a in v.split()}
_ZIP5 = re.compile(r"(?<![\w-])(?:[a-z]-)?(\d{5})(?![\w-])")
_HOUSE = re.compile(r"(?<![\w.-])(\d{1,4})\s?([a-d])?(?![\w.])")
_NO = re.compile(r"\b(?:no|nr|n|núm|num)\.?º?\s*(?=\d)")
_CJK = re.compile("[㐀-鿿]")

PARTS = ["zip", "region", "town", "street", "kind", "number"]


def _digits(text: str) -> str:
    """Kanji numerals up to 99 as digits."""
    if text.isdigit():
        return str(int(text))
    a, ten, b = text.partition("十")
    if not ten:
        return "".join(str(KANJI_DIGITS.index(c) + 1) for c in a if c in KANJI_DIGITS)
    return str(10 * (KANJI_DIGITS.index(a) + 1 if a in KANJI_DIGITS and a else 1) + (KANJI_DIGITS.index(b) + 1 if b and b in KANJI_DIGITS else 0))


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    return "".join("-" if unicodedata.category(c) == "Pd" else c for c in text.translate(_DASH))


def parse(address: str | None) -> tuple[str | None, ...] | None:
    """(zip, region, town, street, kind, number), each null if absent; None if no numbered place is named.

    An address of any length is read; romanised ones without a postcode are placed
    by their names, Latin ones without an English kind of street by ``other_latin``.
    """
    if not address:
        return None
    s = fold(address).strip()
    if _CJK.search(s):
        s = re.sub(r"(?<=[\d号目番地])ー|ー(?=\d)", "-", re.sub(r"\s+", "", s))
        m = _JP.match(s)
        if not m:
            return None
        z1, z2, region, town, street, a, b, c, _ = m.groups()
        street = street.strip("-・,、()")
        if not street and town:
            town, street = None, town
        if not street:
            return None
        return (z1 + z2 if z1 else None, region, town, street, "jp", "-".join([_digits(a) if a else "", str(int(b)), str(int(c))]))
    s = s.lower()
    if (m := _ROMAJI.search(s)) and not _POST.search(s):
        z = _ZIP.search(s)
        # The postcode says where; the romanised names stay out of the comparison.
        number = "-".join(str(int(x)) for x in m.groups())
        if z:
            return (z[1] + z[2], None, None, None, "jp", number)
        names = [re.sub(r"-(?:cho|machi|shi|ku|gun|mura|son|ken|fu|to)$", "", x) for x in _names(s[: m.start()] + "," + s[m.end() :]) if x not in ("japan", "nippon")]
        return (None, names[2] if len(names) > 2 else None, names[1] if len(names) > 1 else None, names[0], "jp", number) if names else None
    zipcode = None
    if m := _POST.search(s):
        zipcode, s = m[1] + m[2], s[: m.start()] + "," + s[m.end() :]
    s = re.sub(r"\bno\.?\s*(?=\d)", "", _LEVEL.sub(",", s))
    for m in _KIND_WORD.finditer(s):
        k = m.start()
        while k and s[k - 1] not in _DELIMITERS:
            k -= 1
        while k < m.start() and not s[k].isalpha():
            k += 1
        if k < m.start():
            break
    else:
        return other_latin(zipcode, s)
    street, kind = re.sub(r"[^\w' -]", "", s[k : m.start()]).strip(), _KIND[m[1]]
    rest = s[:k] + "," + s[m.end() :]
    n = re.search(r"\d+\s?[a-d]?\b(?!\w)", rest)
    if not n or not street:
        return other_latin(zipcode, s)
    names = _names(rest[: n.start()] + "," + rest[n.end() :])
    region = next((x for x in names if x.endswith("shire")), None)
    town = next((x for x in names if x != region), None)
    return (zipcode, region, town, street, kind, n[0].replace(" ", "").lstrip("0"))


def _names(text: str) -> list[str]:
    """What stands between commas and the like and has two letters together."""
    return [x for x in (x.strip(" .-'") for x in re.split(r"[,/()\n]|\s{2,}", text)) if x and re.search(r"[^\W\d_]{2}", x)]


def other_latin(zipcode: str | None, s: str) -> tuple[str | None, ...] | None:
    """As ``parse`` for forms without an English kind of street: the house number stands beside the street's name."""
    if not zipcode and (m := _ZIP5.search(s)):
        zipcode, s = m[1], s[: m.start()] + "," + s[m.end() :]
    s = _NO.sub("", s)
    m = _HOUSE.search(s)
    if not m:
        return None
    lo = max(s.rfind(c, 0, m.start()) for c in ",/()\n") + 1
    hi = min((k for c in ",/()\n" if (k := s.find(c, m.end())) >= 0), default=len(s))
    own = next((x for x in (s[lo : m.start()], s[m.end() : hi]) if re.search(r"[^\W\d_]{2}", x)), None)
    rest = s[:lo] + "," + s[hi:]
    if own is None:  # the number stands between commas of its own
        before = _names(s[:lo])
        own = before[-1] if before else None
        if own is None:
            return None
        rest = rest.replace(own, ",", 1)
    street, kind = re.sub(r"[^\w' -]", "", own).strip(" -'"), "other"
    first, _, more = own.strip().partition(" ") if not own.strip().startswith("c/") else ("c/", "", own.strip()[2:])
    if (word := first.rstrip(".")) in _LEADING and more.strip():
        street, kind = re.sub(r"[^\w' -]", "", more).strip(" -'"), _LEADING[word]
    elif hit := next(((a, k) for a, k in _ENDING if street.rstrip(".").endswith(a) and len(street) > len(a)), None):
        street, kind = street.rstrip(".")[: -len(hit[0])].strip(" -"), hit[1]
    names = _names(rest)
    return (zipcode, None, names[0] if names else None, street, kind, m[1].lstrip("0") + (m[2] or "")) if street else None


def parsed(holders: DataFrame) -> DataFrame:
    """(id, PARTS) of the rows of (id, address) that name a numbered place; each distinct text is parsed where it is read."""
    ship(holders.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, p) for i, a in enumerate(b.column(1).to_pylist()) if (p := parse(a))]
            cols = [pa.array([p[k] for _, p in got], pa.string()) for k in range(len(PARTS))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in got], pa.int32())), *cols], names=["id", *PARTS])

    return holders.mapInArrow(run, "id string, " + ", ".join(f"{p} string" for p in PARTS))


def completed(rows: DataFrame) -> DataFrame:
    """Fills town, street, kind and region of distinct spellings (``spelling``, PARTS, ``n`` rows) from what is usual for the postcode and the town.

    Adds ``known``: the street is the usual one of some postcode. Rows that lack
    the key of a join are spread by their spelling.
    """

    def spread(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumns({f"_j{k}": F.coalesce(F.col(c), F.concat(F.lit("\x00"), F.col("spelling").cast("string"))) for k, c in enumerate(keys)})

    full = rows.where("zip is not null and town is not null and street is not null").groupBy("zip", "town", "street", "kind").agg(F.sum("n").alias("n"))
    by_zip = full.groupBy("zip").agg(F.max_by(F.struct("town", "street", "kind"), F.struct("n", "town", "street")).alias("u")).select(F.col("zip").alias("_j0"), F.col("u.town").alias("_t"), F.col("u.street").alias("_s"))
    by_town = rows.where("town is not null and region is not null").groupBy("town", "region").agg(F.sum("n").alias("n")).groupBy("town").agg(F.max_by("region", F.struct("n", "region")).alias("_r")).withColumnRenamed("town", "_j0")
    known = by_zip.select(F.col("_t").alias("_j0"), F.col("_s").alias("_j1")).distinct().withColumn("known", F.lit(True))
    rows = spread(rows, "zip").join(by_zip, "_j0", "left")
    rows = rows.select("spelling", "n", "zip", "region", F.coalesce("town", "_t").alias("town"), F.coalesce("street", "_s").alias("street"), "kind", "number")
    rows = spread(rows, "town").join(by_town, "_j0", "left").withColumn("region", F.coalesce("region", "_r")).drop("_r", "_j0")
    return spread(rows, "town", "street").join(known, ["_j0", "_j1"], "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("_j0", "_j1")


def sound(street: Column) -> Column:
    """Street name without doubled letters."""
    return F.regexp_replace(F.regexp_replace(F.lower(street), r"[\s'-]+", ""), r"(.)\1+", "$1")


def variants(s: Column) -> Column:
    """The sound and every form of it that lacks one letter, again without doubled letters."""
    drop = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.regexp_replace(F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))), r"(.)\1+", "$1"))
    return F.array_distinct(F.concat(F.array(s), F.filter(drop, lambda x: x != "")))


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b as structs) that share a block, once each."""
    block = lambda *c: F.concat_ws("|", *c)
    by_sound = F.when(F.col("town").isNotNull() & F.col("street").isNotNull(), F.transform(variants(sound(F.col("street"))), lambda v: block(F.lit("s"), F.sort_array(F.split(sound(F.col("town")), "")).cast("string"), v, F.col("number"))))
    by_zip = F.when(F.col("zip").isNotNull(), F.array(block(F.lit("z"), "zip", "number")))
    keyed = nodes.select("node", *PARTS, "known", F.explode(F.concat(F.coalesce(by_zip, F.array().cast("array<string>")), F.coalesce(by_sound, F.array().cast("array<string>")))).alias("block"))
    keyed = keyed.select(F.xxhash64("block").alias("block"), "node", F.struct("node", *PARTS, "known").alias("x"))
    # Blocks of one node are dropped before anything is paired.
    several = keyed.groupBy("block").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("block")
    kept = cut(keyed.join(several, "block", "left_semi"))
    return pairs_of_groups(kept, ["block"], "node", carry="x").select(F.col("x_a").alias("a"), F.col("x_b").alias("b")).dropDuplicates(["a", "b"])


def compared(pairs: DataFrame) -> DataFrame:
    """(a, b, one level per part): 0 missing, 1 equal, 2 close, 3 near, 4 different."""

    def level(part: str, fuzzy: bool) -> Column:
        x, y = F.col(f"a.{part}"), F.col(f"b.{part}")
        out = F.when(x.isNull() | y.isNull(), 0).when(x == y, 1)
        if fuzzy:
            sx, sy = sound(x), sound(y)
            out = out.when(F.sort_array(F.split(sx, "")) == F.sort_array(F.split(sy, "")), 2)
            one = F.arrays_overlap(variants(sx), variants(sy))
            both = F.col("a.known") & F.col("b.known") if part == "street" else F.lit(False)
            out = out.when(both, 4).when(one & (F.least(F.length(x), F.length(y)) >= 4), 2).when(one, 3)
        return out.otherwise(4).alias(part)

    levels = [level("zip", False), level("region", True), level("town", True), level("street", True), level("kind", False)]
    return pairs.select(F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b"), *levels).withColumnsRenamed({"node_a": "a", "node_b": "b"})


def chance(nodes: DataFrame, parts: list[str]) -> dict[str, dict[int, float]]:
    """u of each level: how often two rows drawn at random agree, are close or lack a part; a node counts ``n`` rows."""
    total = max(nodes.agg(F.sum("n").alias("n")).first().n or 0, 1)
    out = {}
    for p in parts:
        same = lambda c: nodes.where(F.col(p).isNotNull()).groupBy(c.alias("v")).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("double") ** 2).alias("s"), F.sum("n").alias("n")).first()  # noqa: B023, E731
        exact, loose = same(F.col(p)), same(F.array_join(F.sort_array(F.split(sound(F.col(p)), "")), ""))
        have = (exact.n or 0) / total
        equal = max((exact.s or 0) / total**2, 1 / total**2)
        close = max((loose.s or 0) / total**2 - equal, equal / 2)
        near = 4 * close
        out[p] = {0: max(1 - have**2, 1e-6), 1: equal, 2: close, 3: near, 4: max(have**2 - equal - close - near, 1e-6)}
    return out


def weigh(patterns: list[tuple[tuple[int, ...], int]], u: list[dict[int, float]]) -> dict[tuple[int, ...], float]:
    """Posterior of a match for every pattern, by expectation maximisation with u held fixed."""
    m = [{0: x[0], 1: 0.8 * (1 - x[0]), 2: 0.1 * (1 - x[0]), 3: 0.05 * (1 - x[0]), 4: 0.05 * (1 - x[0])} for x in u]
    share, post = 0.5, {}
    total = sum(n for _, n in patterns)
    for _ in range(EM_ROUNDS):
        for g, _n in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(m[k][v]) - math.log(u[k][v]) for k, v in enumerate(g))
            post[g] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        hits = sum(post[g] * n for g, n in patterns)
        share = min(max(hits / total, 1e-4), 1 - 1e-4)
        for k in range(len(u)):
            for v in m[k]:
                m[k][v] = (sum(post[g] * n for g, n in patterns if g[k] == v) + 0.01) / (hits + 0.05)
    return post


def components(links: DataFrame) -> DataFrame:
    """(node, place): the smallest node reachable, by repeated minimum of neighbours and jump."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("place")))
    for _ in range(MAX_ROUNDS):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("place").alias("near"))
        step = label.join(near, label.node == near.a, "left").select("node", F.col("place").alias("old"), F.least("place", F.coalesce("near", "place")).alias("place"))
        jump = label.select(F.col("node").alias("place"), F.col("place").alias("root"))
        new = cut(step.join(jump, "place", "left").select("node", "old", F.coalesce("root", "place").alias("place")))
        label = new.select("node", "place")
        if new.where("old != place").isEmpty():
            return label
    raise RuntimeError(f"places were not settled after {MAX_ROUNDS} rounds")


def places(holders: DataFrame) -> DataFrame:
    """(id, place) for each holder of (id, address) that names a numbered place.

    Null, blank and placeholder addresses and such without a house number name
    no place and have no row; repeated rows stay; an empty table has no rows.
    Only distinct spellings are completed, blocked and compared.
    """
    of = lambda: F.xxhash64(*(F.coalesce(F.col(p), F.lit("\x00")) for p in PARTS))
    rows = cut(parsed(holders).withColumn("spelling", of()))
    spellings = rows.groupBy("spelling").agg(*(F.first(p).alias(p) for p in PARTS), F.count("*").alias("n"))
    spellings = cut(completed(cut(spellings)).withColumn("node", of()))
    nodes = cut(spellings.groupBy("node").agg(*(F.first(c).alias(c) for c in [*PARTS, "known"]), F.sum("n").alias("n")))
    rows = rows.select("id", "spelling").join(spellings.select("spelling", "node"), "spelling")
    pairs = cut(compared(candidates(nodes)))
    parts = ["zip", "region", "town", "street", "kind"]
    counts = [(tuple(r[p] for p in parts), r["count"]) for r in pairs.groupBy(*parts).count().collect()]  # at most 5^5 rows
    spark = holders.sparkSession
    if counts:
        u = chance(nodes, parts)
        post = weigh(counts, [u[p] for p in parts])
        good = spark.createDataFrame([(*g, True) for g, w in post.items() if w >= MATCH_FROM] or [(9,) * 5 + (True,)], ", ".join(f"{p} int" for p in parts) + ", ok boolean")
        label = components(pairs.join(F.broadcast(good), parts, "left_semi"))
        rows = rows.join(label, "node", "left").withColumn("place", F.coalesce("place", "node"))
    else:
        rows = rows.withColumn("place", F.col("node"))
    return rows.select("id", "place")


def holders_of(entities: DataFrame, records: DataFrame) -> DataFrame:
    """(id, address) of all entities, and of the records not resolved to one."""
    return entities.select(F.col("entity_id").alias("id"), "address").unionByName(records.where("entity_id is null").select(F.col("record_id").alias("id"), "address")).where("id is not null and address is not null")


def place_pairs(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (id_a < id_b) of holders at one place."""
    return pairs_of_groups(cut(places(holders_of(entities, records))), ["place"], "id").select("id_a", "id_b")
