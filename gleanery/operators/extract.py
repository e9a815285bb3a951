"""Pages to structured fields: one Arrow stage per page, everything after it built-in."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import PHONE, first_filled
from ..functions.urls import SOCIAL
from ..schemas import PAGE

#: Links, social links and images kept per page.
MOST_LINKS, MOST_SOCIAL, MOST_IMAGES = 500, 50, 100
_PHONE = re.compile(PHONE)
_PUSH = re.compile(r"dataLayer\.push\s*\(\s*(?=\{)", re.I)


def unescape_values(x):
    """Entities decoded in every string value, at any depth; keys stay."""
    if isinstance(x, str):
        return _html.unescape(x)
    if isinstance(x, list):
        return [unescape_values(y) for y in x]
    return {k: unescape_values(v) for k, v in x.items()} if isinstance(x, dict) else x


def linked_data(scripts: list[str]) -> list[dict]:
    """Blocks of the page's JSON-LD scripts: list items, ``@graph`` items or the object itself; broken ones are skipped."""
    out: list[dict] = []
    for raw in scripts:
        try:
            data = json.loads(raw)
        except ValueError:
            continue
        if isinstance(data, dict):
            data = data["@graph"] if isinstance(data.get("@graph"), list) else [data]
        if isinstance(data, list):
            out += [unescape_values(d) for d in data if isinstance(d, dict)]
    return out


def data_layer(page: str) -> list[dict]:
    """Items pushed to the page's data layer, each over the push's other keys; only strict JSON objects count."""
    out: list[dict] = []
    decoder = json.JSONDecoder()
    for m in _PUSH.finditer(page):
        try:
            data, _ = decoder.raw_decode(page, m.end())
        except ValueError:
            continue
        data = unescape_values(data)
        shop = data.pop("ecommerce", None)
        if isinstance(shop, dict) and isinstance(shop.get("items"), list):
            out += [data | i for i in shop["items"] if isinstance(i, dict)]
        elif data:
            out.append(data)
    return out


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.heading: list[str] | None = None
        self.canonical = self.description = None
        self.links: list[str] = []
        self.images: list[str] = []
        self.scripts: list[str] = []
        self.words: list[str] = []
        self.within: str | None = None
        self.script_kind: str | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v for k, v in attrs if v is not None}
        if tag == "title" and self.title is None:
            self.title, self.within = [], "title"
        elif tag == "h1" and self.heading is None:
            self.heading, self.within = [], "h1"
        elif tag == "link" and self.canonical is None and "canonical" in a.get("rel", "").lower().split():
            self.canonical = a.get("href")
        elif tag == "meta" and self.description is None and a.get("name") == "description":
            self.description = a.get("content")
        elif tag == "a" and "href" in a:
            self.links.append(a["href"])
        elif tag == "img" and "src" in a:
            self.images.append(a["src"])
        elif tag == "script":
            self.script_kind = a.get("type", "")
            if self.script_kind == "application/ld+json":
                self.scripts.append("")

    def handle_endtag(self, tag):
        if tag == self.within:
            self.within = None
        elif tag == "script":
            self.script_kind = None

    def handle_data(self, data):
        if self.script_kind is not None:
            if self.script_kind == "application/ld+json":
                self.scripts[-1] += data
            return
        self.words.append(data)
        if self.within == "title":
            self.title.append(data)
        elif self.within == "h1":
            self.heading.append(data)


def _joined(parts: list[str] | None) -> str | None:
    return "".join(p.strip() for p in parts or []) or None


def _absolute(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link)
    except ValueError:
        return None


def read_page(page: str | None, base: str | None) -> dict:
    """Fields of PAGE for one page."""
    p = _Page()
    p.feed(page or "")
    p.close()
    base = base or ""
    blocks = linked_data(p.scripts)
    name = next((b["name"] for b in blocks if b.get("name")), None) or _joined(p.heading)
    address = None
    for b in blocks:
        a = b.get("address")
        if isinstance(a, dict):
            a = ", ".join(str(v) for v in map(a.get, ("postalCode", "addressRegion", "addressLocality", "streetAddress")) if v)
        address = address or (a if isinstance(a, str) else None)
    phone = next((b["telephone"] for b in blocks if b.get("telephone")), None)
    if not phone and (m := _PHONE.search(" ".join(p.words))):
        phone = m[0]
    links = [u for u in (_absolute(base, x) for x in p.links) if u and u.startswith(("http://", "https://"))]
    images = [u for u in (_absolute(base, x) for x in p.images) if u]
    text = lambda x: None if x is None else _html.unescape(str(x))
    return {
        "title": text(_joined(p.title)), "canonical_url": (p.canonical and _absolute(base, p.canonical)) or base, "meta_description": text(p.description.strip()) if p.description else None,
        "json_ld": [json.dumps(b, ensure_ascii=False) for b in blocks], "data_layer": [json.dumps(b, ensure_ascii=False) for b in data_layer(page or "")],
        "name": text(name), "address": text(address), "telephone": None if phone is None else str(phone), "links": list(dict.fromkeys(links))[:MOST_LINKS],
        "social_urls": list(dict.fromkeys(u for u in links if any(s in urlsplit(u).netloc.lower() for s in SOCIAL)))[:MOST_SOCIAL], "image_urls": list(dict.fromkeys(images))[:MOST_IMAGES],
    }


def extract_pages(df: DataFrame, body: str = "content", base: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and a struct ``page`` (PAGE) for every row; a null body gives an empty page.

    One mapInArrow stage, so a filter on its result does not run it twice.
    """
    rows = df.select(*keep, F.col(body).alias("_body"), F.col(base).alias("_base"))
    schema = T.StructType([*(f for f in rows.schema if f.name in keep), T.StructField("page", PAGE)])
    arrow = to_arrow_type(PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = pa.array([read_page(x, u) for x, u in zip(b.column("_body").to_pylist(), b.column("_base").to_pylist())], arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pages], names=[*keep, "page"])

    return rows.mapInArrow(run, schema)


# ---- adapters: projections from a page to a record ----

Adapter = Callable[[DataFrame], DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def adapter(name: str) -> Callable[[Adapter], Adapter]:
    def keep(f: Adapter) -> Adapter:
        _ADAPTERS[name] = f
        return f

    return keep


def get_adapter(name: str) -> Adapter:
    if name not in _ADAPTERS:
        raise KeyError(f"unknown adapter {name!r}; known are {sorted(_ADAPTERS)}")
    return _ADAPTERS[name]


def block_of(types: list[str]) -> Column:
    """The first JSON-LD block of one of ``types``, as text; null without one."""
    kinds = lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$.@type"), "array<string>"), F.array(F.get_json_object(b, "$.@type")))
    return F.get(F.filter("page.json_ld", lambda b: F.arrays_overlap(kinds(b), F.array(*map(F.lit, types)))), 0)


def as_record(pages: DataFrame, types: list[str], external: list[str], extra: dict[str, str | tuple[str, ...]], confidence: tuple[float, float], required: list[str]) -> DataFrame:
    """Adds ``record``: block fields first, the page's own where the block has none."""
    b = block_of(types)
    j = lambda path: F.get_json_object(b, path)
    name = first_filled(j("$.name"), F.col("page.name"), F.col("page.title"))
    missing = {"name": name, "address": F.col("page.address")}
    fields = F.map_filter(F.create_map(*(x for k, path in extra.items() for x in (F.lit(k), text_of(b, *path) if isinstance(path, tuple) else j(path)))), lambda _k, v: v.isNotNull()) if extra else F.create_map().cast("map<string,string>")
    record = F.struct(
        name.alias("name"), F.lit(types[0]).alias("entity_type"), F.col("page.canonical_url").alias("canonical_url"), F.lit(None).cast("string").alias("domain"), F.col("page.address").alias("address"),
        first_filled(j("$.telephone"), F.col("page.telephone")).alias("telephone"), (first_filled(*(j(f"$.{k}") for k in external)) if external else F.lit(None).cast("string")).alias("external_id"),
        F.when(b.isNotNull(), confidence[0]).otherwise(confidence[1]).alias("confidence"), fields.alias("fields"),
        F.array_compact(F.array(*(F.when(first_filled(missing[r]).isNull(), r) for r in required))).alias("missing_required"), F.lit(False).alias("skip"), F.lit(None).cast("string").alias("skip_reason"),
    )
    return pages.withColumn("record", record)


@adapter("generic")
def generic(pages: DataFrame) -> DataFrame:
    return as_record(pages, ["Thing"], [], {}, (0.6, 0.6), ["name"])


def layer_fields() -> Column:
    """The page's data layer as one map: later items win; nested values are JSON text."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate("page.data_layer", empty, lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _v: ~F.map_contains_key(F.coalesce(F.from_json(x, "map<string,string>"), empty), k)), F.coalesce(F.from_json(x, "map<string,string>"), empty)))


def text_of(b: Column, *paths: str) -> Column:
    """The first of the paths that holds text or a number, not an object or list."""
    plain = lambda c: F.when(~F.ltrim(c).rlike(r"^[\[{]"), c)
    return first_filled(*(plain(F.get_json_object(b, p)) for p in paths))


def list_of(b: Column, path: str) -> Column:
    """A list of texts, a single text as a list of one; null where there is neither."""
    v = F.get_json_object(b, path)
    return F.when(F.ltrim(v).startswith("["), F.filter(F.from_json(v, "array<string>"), lambda x: x.isNotNull())).when((v != "") & ~F.ltrim(v).startswith("{"), F.array(v))


# Keys of trade numbers in order of preference, and what an external id is taken from after them.
GTIN_KEYS = ("gtin13", "gtin14", "gtin12", "gtin8", "gtin")
MOST_FIELD_IMAGES = 5


@adapter("product")
def product(pages: DataFrame) -> DataFrame:
    return as_record(pages, ["Product"], ["gtin13", "gtin14", "gtin12", "gtin8", "gtin", "mpn", "sku"], {"brand": ("$.brand.name", "$.brand"), "category": ("$.category",), "price": ("$.offers.price", "$.offers[0].price"), "currency": ("$.offers.priceCurrency", "$.offers[0].priceCurrency"), "image": "$.image"}, (0.75, 0.5), ["name"])


@adapter("catalogue_product")
def catalogue_product(pages: DataFrame) -> DataFrame:
    """Adds ``record`` of a product page; a page without a Product block is a skip.

    The block comes first; the data layer only fills what it leaves empty.
    """
    b, dl = block_of(["Product"]), F.col("_layer")
    d = lambda k: F.element_at(dl, k)
    gtin = text_of(b, *(f"$.{k}" for k in GTIN_KEYS))
    name = first_filled(text_of(b, "$.name"), F.col("page.name"), F.col("page.title"))
    images = F.coalesce(list_of(b, "$.image"), F.when(d("image_url") != "", F.array(d("image_url"))), F.slice("page.image_urls", 1, MOST_FIELD_IMAGES))
    named = {
        "brand": first_filled(text_of(b, "$.brand.name", "$.brand"), d("item_brand")), "manufacturer": text_of(b, "$.manufacturer.name", "$.manufacturer"), "category": first_filled(text_of(b, "$.category"), d("item_category2"), d("item_category")), "category_l1": d("item_category"), "category_l2": d("item_category2"),
        "scale": text_of(b, "$.size"), "sku": text_of(b, "$.sku"), "mpn": text_of(b, "$.mpn"), "gtin": gtin, "product_master_code": d("product_master_code"), "item_id": d("item_id"),
        "price": first_filled(text_of(b, "$.offers.price", "$.offers[0].price"), d("price")), "currency": text_of(b, "$.offers.priceCurrency", "$.offers[0].priceCurrency"), "availability": text_of(b, "$.offers.availability", "$.offers[0].availability"),
        "release_date": text_of(b, "$.releaseDate"), "reservation_deadline": d("reservation_deadline"), "image_urls": F.to_json(F.slice(images, 1, MOST_FIELD_IMAGES)),
    }
    fields = F.map_filter(F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))), lambda _k, v: v.isNotNull())
    skip, null = b.isNull(), F.lit(None).cast("string")
    external = first_filled(gtin, text_of(b, "$.mpn"), text_of(b, "$.sku"), d("product_master_code"), d("item_id"))
    record = F.struct(
        F.when(~skip, name).alias("name"), F.lit("Product").alias("entity_type"), F.col("page.canonical_url").alias("canonical_url"), null.alias("domain"), null.alias("address"), null.alias("telephone"), F.when(~skip, external).alias("external_id"),
        F.when(skip, 0.0).otherwise(0.8).alias("confidence"), F.when(skip, F.create_map().cast("map<string,string>")).otherwise(fields).alias("fields"), F.when(~skip & name.isNull(), F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("missing_required"),
        skip.alias("skip"), F.when(skip, "no Product block").alias("skip_reason"),
    )
    return pages.withColumn("_layer", layer_fields()).withColumn("record", record).drop("_layer")


@adapter("local_business")
def local_business(pages: DataFrame) -> DataFrame:
    return as_record(pages, ["LocalBusiness", "LodgingBusiness", "Organization"], [], {"opening_hours": "$.openingHours", "geo": "$.geo"}, (0.75, 0.5), ["name", "address"])


@adapter("person")
def person(pages: DataFrame) -> DataFrame:
    out = as_record(pages, ["Person"], [], {"job_title": "$.jobTitle", "affiliation": "$.affiliation.name"}, (0.75, 0.5), ["name"])
    social = F.coalesce(list_of(block_of(["Person"]), "$.sameAs"), F.col("page.social_urls"))
    return out.withColumn("record", F.col("record").withField("fields", F.map_concat("record.fields", F.when(F.size(social) > 0, F.create_map(F.lit("social_urls"), F.to_json(social))).otherwise(F.create_map().cast("map<string,string>")))))


def records_of(pages: DataFrame, adapters: dict[str, str], kind: str = "collector_type", body: str = "content", base: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, record) of fetched pages by their collector's type: one record for each page, none to many for each answer of an API.

    ``adapters`` says which adapter a type has; ``api`` needs none, other types are left out.
    """
    frames = [get_adapter(a)(extract_pages(pages.where(F.col(kind) == t), body, base, keep)).select(*keep, "record") for t, a in adapters.items()]
    null = F.lit(None).cast("string")
    items = api_records(pages.where(F.col(kind) == "api"), body)
    lacking = F.array_compact(F.array(F.when(F.col("name").isNull(), F.lit("name")), F.when(F.col("external_id").isNull(), F.lit("external_id"))))
    api = items.select(*keep, F.struct(F.col("name"), F.lit("item").alias("entity_type"), F.col("fields")["url"].alias("canonical_url"), null.alias("domain"), null.alias("address"), null.alias("telephone"), F.col("external_id"), F.lit(0.8).alias("confidence"), F.col("fields"), lacking.alias("missing_required"), F.lit(False).alias("skip"), null.alias("skip_reason")).alias("record"))
    for f in frames:
        api = api.unionByName(f)
    return api


def api_records(df: DataFrame, body: str = "content", items_path: str | None = None) -> DataFrame:
    """One row per item of a JSON answer (``item`` text, ``name``, ``external_id``, ``fields``).

    Items are the top-level list, or the list under ``items_path``, ``items``,
    ``results`` or ``data``; broken JSON gives no rows.
    """
    as_list = lambda path: F.from_json(F.get_json_object(body, path), "array<string>")
    whole = F.when(F.trim(body).startswith("["), F.from_json(F.col(body), "array<string>"))
    items = F.coalesce(*([as_list(f"$.{items_path}")] if items_path else []), as_list("$.items"), as_list("$.results"), as_list("$.data"), whole)
    one = df.withColumn("item", F.explode(items)).where(F.col("item").startswith("{"))
    fields = F.from_json("item", "map<string,string>")
    return one.select("*", fields["name"].alias("name"), F.coalesce(fields["id"], fields["external_id"]).alias("external_id"), F.map_filter(fields, lambda k, _v: ~k.isin("id", "name", "external_id")).alias("fields"))
