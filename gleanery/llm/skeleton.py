"""One form for texts that look the same but are stored with other characters.

The skeleton of a text: decompose, replace every character by its prototype from
the look-alike table, decompose again. Texts read the same if their skeletons
are equal. Letter case, punctuation other than dashes and ASCII white space stay
as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pairs_of_groups, ship

# Letters drawn alike, as "look-alike, prototype" in the order of the alphabets.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ҽe"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa γy ιi κk νv οo ρp σo τt υu χx ϲc ϳj"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
LATIN = "ıi ɑa ɡg ɩi ʋu ᴏo ꞌ' ՕO օo ոn սu հh"
# Names of Coptic letters and of the Greek ones they are drawn like.
COPTIC = "ALFA ALPHA,VIDA BETA,EIE EPSILON,ZATA ZETA,HATE ETA,IAUDA IOTA,KAPA KAPPA,MI MU,NI NU,O OMICRON,RO RHO,SIMA SIGMA,TAU TAU,UA UPSILON,KHI CHI"
# Small capitals drawn like small letters.
SMALL_CAPITALS = "COSUVWXZ"
# Kana against ideographs and the two kana scripts against each other.
KANA = "力カ 口ロ 二ニ 工エ 夕タ 八ハ 才オ 千チ 三ミ 卜ト へヘ べベ ぺペ りリ 一ー 丿ノ 厶ム 乂メ ㇏ヽ"
INVISIBLE = "00ad 034f 061c 115f 1160 17b4 17b5 180b 180c 180d 180e 200b 200c 200d 200e 200f 202a 202b 202c 202d 202e 2060 2061 2062 2063 2064 2066 2067 2068 2069 3164 feff ffa0"
#: Dashes besides the characters of category Pd: minus, long-vowel mark and drawn lines.
DASHES = "2212 30fc 2500 2796 02d7 2043 fe63 ff70"


_COPTIC = dict(x.split(" ") for x in COPTIC.split(","))


class Table(dict):
    """str.translate table; a character's prototype is worked out when first met."""

    def __init__(self) -> None:
        super().__init__()
        for pair in f"{CYRILLIC} {GREEK} {CHEROKEE} {LISU} {LATIN} {KANA}".split(" "):
            self[ord(pair[0])] = pair[1]
        for code in INVISIBLE.split():
            self[int(code, 16)] = ""
        for code in DASHES.split():
            self[int(code, 16)] = "-"
        for pair in KANA.split(" "):  # through the table again: 一 looks like the long-vowel mark, that like a dash
            self[ord(pair[0])] = self.get(ord(pair[1]), pair[1])
        self[0x309B], self[0x309C] = "゙", "゚"

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Pd":
            out = "-"
        elif kind == "Zs":
            out = " "
        elif 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out = ""
        else:
            out = self.derived(ch, unicodedata.name(ch, ""))
        self[code] = out
        return out

    def derived(self, ch: str, name: str) -> str:
        """The prototype that the character's own data give: its single compatible letter or ideograph, or its name."""
        how = unicodedata.decomposition(ch).split()
        if len(how) == 2 and how[0] == "<compat>" and unicodedata.category(ch) in ("Lo", "Ll", "Lu", "Nl", "So"):
            return self[int(how[1], 16)]  # Roman numerals, radicals, variants of letters
        if name.startswith("COPTIC "):
            kind, _, letter = name.rpartition(" ")
            if letter in _COPTIC:
                return self[ord(unicodedata.lookup(f"GREEK {kind[7:]} {_COPTIC[letter]}"))]
        if name.startswith("LATIN LETTER SMALL CAPITAL ") and name[27:] in SMALL_CAPITALS:
            return name[27:].lower()
        return ch


class Widths(dict):
    """Width, font and no-break forms decompose; other compatibility forms do not read the same."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        how = unicodedata.decomposition(ch)
        same = how.startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")) or 0xFB00 <= code <= 0xFB06
        self[code] = out = unicodedata.normalize("NFKC", ch) if same else ch
        return out


@lru_cache(maxsize=1)
def tables() -> tuple[Widths, Table]:
    return Widths(), Table()


def skeleton(text: str) -> str:
    widths, alike = tables()
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text.translate(widths)).translate(alike))


def read_forms(df: DataFrame, fields: list[str], id_col: str = "entity_id") -> DataFrame:
    """Rows (id, field, value, form) for each value of ``fields`` that is not blank.

    Null values, empty ones and those of blanks and invisible characters only give
    no row; repeated rows stay; an empty table gives no rows.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), *(F.col(f).cast("string").alias(f"_f{k}") for k, f in enumerate(fields)))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for k, f in enumerate(fields):
                at, raw, form = [], [], []
                for i, v in enumerate(b.column(1 + k).to_pylist()):
                    if v and (s := skeleton(v)).strip():
                        at.append(i), raw.append(v), form.append(s)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array([f] * len(at), pa.string()), pa.array(raw, pa.string()), pa.array(form, pa.string())], names=["_id", "field", "value", "form"])

    return rows.mapInArrow(run, f"_id {kind}, field string, value string, form string").withColumnRenamed("_id", id_col)


def alike_classes(df: DataFrame, fields: list[str], id_col: str = "entity_id") -> DataFrame:
    """Rows (field, form, n_values, n_rows): the forms stored with more than one spelling."""
    one = read_forms(df, fields, id_col).groupBy("field", "form", "value").agg(F.count("*").alias("n"))
    return one.groupBy("field", "form").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows")).where("n_values > 1")


def alike_pairs(df: DataFrame, fields: list[str], id_col: str = "entity_id") -> DataFrame:
    """Pairs (id_a < id_b, field) whose values read the same but are different strings."""
    forms = read_forms(df, fields, id_col)
    several = forms.groupBy("field", "form").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo != hi").select("field", "form")
    # Only spellings of forms that have several go on.
    kept = cut(forms.join(several, ["field", "form"], "left_semi"))
    return pairs_of_groups(kept, ["field", "form"], id_col, "value").select("id_a", "id_b", "field")
