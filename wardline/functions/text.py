"""Text functions over log lines, sizes, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9.]+)"


def number(text: Column, pattern: str) -> Column:
    """First group of ``pattern`` as a double; null where the text doesn't match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def summary_line(line: Column) -> dict[str, Column]:
    """kmpp, spread and std of a '#Best Km/p' summary line."""
    keys = {"kmpp": "Km/p", "spread": "spread", "std": "std"}
    return {k: number(line, rf"Best Km/p: .*?{name}={NUMBER}") for k, name in keys.items()}


def analyzer_text(text: Column) -> dict[str, Column]:
    """Statistics printed by the analyzer: distance to the population centre and, in newer texts, to the land centre."""
    top, least = number(text, rf"max={NUMBER}"), number(text, rf"min={NUMBER}")
    land = F.coalesce(number(text, rf"{NUMBER}\s*Km/person to land center"), number(text, rf"{NUMBER}\s*Km/person"))
    return {"kmpp": number(text, rf"{NUMBER}\s*Km/person"), "land_kmpp": land, "spread": top - least, "std": number(text, rf"std={NUMBER}")}


def log_line(line: Column) -> dict[str, Column]:
    """Fields of one line of a run log; null where the line has none."""
    return {
        "generation": number(line, r"gen(?:eration)? (\d+)").cast("int"),
        "kmpp": number(line, rf"{NUMBER} Km/person"),
        "std": number(line, rf"std={NUMBER}"),
        "max_pop": number(line, rf"max={NUMBER}"),
        "min_pop": number(line, rf"min={NUMBER}"),
        "nod_pop": number(line, rf"in no district .pop={NUMBER}"),
    }


def start_stats(text: Column) -> dict[str, Column]:
    """Statistics printed at a run's start."""
    top, least = number(text, rf"max={NUMBER}"), number(text, rf"min={NUMBER}")
    return {"kmpp": number(text, rf"{NUMBER}\s+Km/p"), "average": number(text, rf"avg={NUMBER}"), "std": number(text, rf"std={NUMBER}"), "spread": top - least}


def variability_line(line: Column, per: int = 5000) -> dict[str, Column]:
    """Variability of kmpp and spread over ``per`` generations."""
    return {k: number(line, rf"{name} var per {per}={NUMBER}") for k, name in {"kmpp_var": "kmpp", "spread_var": "spread"}.items()}


def run_seconds(text: Column) -> Column:
    return number(text, rf"(?i)district calculation:\s*{NUMBER}\s*sec")


def size_bytes(text: Column) -> Column:
    """'10k', '5M', '2G' with decimal multipliers."""
    n = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(text, r"([kKmMgGtT])", 1))
    return n * F.when(unit == "k", 1000).when(unit == "m", 10**6).when(unit == "g", 10**9).when(unit == "t", 10**12).otherwise(1)


def human_size(n: Column) -> Column:
    step = lambda f, u: F.concat(F.format_string("%.1f", n / float(f)), F.lit(u))
    return F.when(n >= 10**9, step(10**9, "G")).when(n >= 10**6, step(10**6, "M")).when(n >= 1000, step(1000, "k")).otherwise(n.cast("string"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "t", "true", "y", "yes", "on"), F.lit(False))


def clean_int(text: Column) -> Column:
    """Numbers with thousands commas; empty and null count as 0."""
    return F.coalesce(F.regexp_replace(text, ",", "").try_cast("long"), F.lit(0).cast("long"))


def clean_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)&nbsp;|<br\s*/?>", " "), r"\s+", " "))


def indent_width(text: Column) -> Column:
    """Columns of leading white space, a tab as eight."""
    return F.length(F.regexp_replace(F.regexp_extract(text, r"^([ \t]*)", 1), "\t", "        "))


def pipe_field(line: Column, n: int, sep: str = r"\|") -> Column:
    return F.get(F.split(line, sep), F.lit(n))


def leading_int(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")


def config_parts(name: Column) -> dict[str, Column]:
    """'XX_Body' -> state, body."""
    return {"state": F.substring_index(name, "_", 1), "body": F.regexp_extract(name, r"^[^_]*_(.*)$", 1)}


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def query_args(text: Column) -> Column:
    """'a=1&b=2' -> map."""
    return F.str_to_map(text, F.lit("&"), F.lit("="))


def query_decoded(text: Column) -> Column:
    """'a=1&b=x+y%21' -> map, as a form sends it; of a key that comes more than once the last value stays."""
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    key = lambda p: F.url_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.when(F.instr(p, "=") > 0, F.url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("")
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != key(p)), F.create_map(key(p), value(p))))


def query_text(args: Column) -> Column:
    """A map as the text of a URL query, keys in order."""
    pairs = F.array_sort(F.map_entries(args))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(F.coalesce(e["value"], F.lit(""))))), "&")


def general(value: Column, digits: int) -> Column:
    """A number to ``digits`` digits without trailing zeros, in powers of ten where it is very small or large, as C prints %g."""
    shown = F.format_string(f"%.{digits - 1}e", F.abs(value.cast("double")))
    mantissa, power = F.replace(F.substring_index(shown, "e", 1), F.lit(".")), F.substring_index(shown, "e", -1).cast("int")
    trim = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0*$", "")).otherwise(t)
    whole = F.concat(F.substring(mantissa, F.lit(1), power + 1), F.lit("."), F.substring(mantissa, power + 2, F.lit(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), mantissa)
    far = F.concat(trim(F.concat(F.substring(mantissa, 1, 1), F.lit("."), F.substring(mantissa, 2, digits))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    plain = F.when(value == 0, "0").when((power < -4) | (power >= digits), far).when(power < 0, trim(small)).otherwise(trim(whole))
    return F.concat(F.when(value < 0, "-").otherwise(""), plain)


def merge_args(base: Column, over: Column) -> Column:
    """``base`` with the keys of ``over`` replaced or added."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def binlog_dump(line: Column) -> dict[str, Column]:
    """kmpp and the smallest and largest population of a dumped binary-log record."""
    return {"kmpp": number(line, rf"kmpp={NUMBER}"), "min_pop": number(line, r"minPop=([0-9]+)"), "max_pop": number(line, r"maxPop=([0-9]+)")}


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#x27")):
        text = F.replace(text, F.lit(sign), F.lit(f"&{name};"))
    return text


def url_join(*parts: Column) -> Column:
    """Parts joined by single slashes; empty ones are left out and the ends stay as they are."""
    filled = F.filter(F.array(*parts), lambda x: F.length(x) > 0)
    inner = F.transform(filled, lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(x, "^/", "")))
    return F.array_join(F.transform(inner, lambda x, i: F.when(i == F.size(filled) - 1, x).otherwise(F.regexp_replace(x, "/$", ""))), "/")


def strip_comments(text: Column) -> Column:
    """A template without its {# ... #} comments, which may span lines."""
    return F.regexp_replace(text, r"(?s)\{#.*?#\}", "")


def races_add_up(total: Column, one: Column, more: Column, by_number: list[Column], parts: list[Column]) -> Column:
    """Whether race counts hold together: people of one race and of more within the total, the counts by
    number of races within both, and the single races within those of one race."""
    numbered, single = sum(by_number[1:], by_number[0]), sum(parts[1:], parts[0])
    return (total >= one + more) & (one + more >= numbered) & (total >= numbered) & (one >= single)


def bundle_rank(name: Column) -> Column:
    """Orders shape bundles of one state: newer year first, then the census vintages 10, 00 and none."""
    vintage = F.regexp_extract(name, r"(?i)_tabblock(\d*)\.zip$", 1)
    kind = F.when(vintage == "10", 2).when(vintage != "", 1).otherwise(0)
    return F.struct(F.regexp_extract(name, r"tl_(\d{4})_", 1).try_cast("int").alias("year"), kind.alias("vintage"))


# States, their postal codes and census numbers.
STATES = """
Alabama AL 1, Alaska AK 2, Arizona AZ 4, Arkansas AR 5, California CA 6, Colorado CO 8, Connecticut CT 9, Delaware DE 10,
District of Columbia DC 11, Florida FL 12, Georgia GA 13, Hawaii HI 15, Idaho ID 16, Illinois IL 17, Indiana IN 18, Iowa IA 19,
Kansas KS 20, Kentucky KY 21, Louisiana LA 22, Maine ME 23, Maryland MD 24, Massachusetts MA 25, Michigan MI 26, Minnesota MN 27,
Mississippi MS 28, Missouri MO 29, Montana MT 30, Nebraska NE 31, Nevada NV 32, New Hampshire NH 33, New Jersey NJ 34,
New Mexico NM 35, New York NY 36, North Carolina NC 37, North Dakota ND 38, Ohio OH 39, Oklahoma OK 40, Oregon OR 41,
Pennsylvania PA 42, Rhode Island RI 44, South Carolina SC 45, South Dakota SD 46, Tennessee TN 47, Texas TX 48, Utah UT 49,
Vermont VT 50, Virginia VA 51, Washington WA 53, West Virginia WV 54, Wisconsin WI 55, Wyoming WY 56, Puerto Rico PR 72
"""


def state_rows() -> list[tuple[str, str, int]]:
    """(name, postal code, census number)."""
    return [(" ".join(w[:-2]), w[-2], int(w[-1])) for w in (row.split() for row in STATES.split(","))]
