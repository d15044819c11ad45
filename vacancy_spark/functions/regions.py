"""UK address -> region as column expressions.

The per-row parser is re-expressed as one JVM expression: a ``CASE`` chain of exact city
membership, a postcode-area map lookup and one ``rlike`` alternation per region. It runs
inside whole-stage codegen, with no Python worker and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, trim_ws

# Regions in declared order (the order decides ties) with their keywords.
UK_REGIONS = [
    ("London", ["london", "greater london", "ec1", "ec2", "ec3", "ec4", "wc1", "wc2", "n1", "nw1",
                "se1", "sw1", "e1", "w1"]),
    ("South East", ["surrey", "kent", "sussex", "berkshire", "hampshire", "oxfordshire",
                    "buckinghamshire", "brighton", "reading", "slough", "farnham", "bicester",
                    "bracknell", "upminster", "macclesfield", "kings hill", "warfield", "camberley",
                    "cheshunt", "guildford", "crawley", "basingstoke", "eastbourne", "hastings",
                    "canterbury", "maidstone", "ashford", "tunbridge wells"]),
    ("South West", ["bristol", "devon", "cornwall", "dorset", "somerset", "gloucestershire",
                    "wiltshire", "bath", "exeter", "plymouth", "swindon", "bournemouth", "poole",
                    "taunton", "gloucester", "cheltenham"]),
    ("East of England", ["essex", "hertfordshire", "bedfordshire", "cambridgeshire", "norfolk",
                         "suffolk", "luton", "norwich", "cambridge", "hertford", "stevenage",
                         "watford", "st albans", "chelmsford", "colchester", "ipswich",
                         "peterborough"]),
    ("East Midlands", ["leicestershire", "nottinghamshire", "derbyshire", "lincolnshire",
                       "northamptonshire", "leicester", "nottingham", "derby", "northampton",
                       "lincoln", "mansfield"]),
    ("West Midlands", ["birmingham", "coventry", "wolverhampton", "warwickshire", "worcestershire",
                       "staffordshire", "shropshire", "herefordshire", "dudley", "walsall",
                       "solihull", "west bromwich", "stoke", "telford", "worcester", "hereford",
                       "shrewsbury"]),
    ("Yorkshire and the Humber", ["yorkshire", "leeds", "sheffield", "bradford", "hull", "york",
                                  "doncaster", "wakefield", "barnsley", "rotherham", "huddersfield",
                                  "halifax", "harrogate", "scarborough"]),
    ("North West", ["manchester", "liverpool", "lancashire", "cheshire", "merseyside", "cumbria",
                    "preston", "bolton", "blackpool", "crewe", "widnes", "chester", "birkenhead",
                    "knutsford", "neston", "warrington", "stockport", "oldham", "rochdale",
                    "salford", "wigan", "blackburn", "burnley", "carlisle", "lancaster"]),
    ("North East", ["newcastle", "sunderland", "durham", "tyne and wear", "northumberland", "tees",
                    "middlesbrough", "gateshead", "darlington", "hartlepool", "stockton"]),
    ("Scotland", ["edinburgh", "glasgow", "aberdeen", "dundee", "inverness", "scotland",
                  "scottish", "stirling", "perth", "paisley"]),
    ("Wales", ["cardiff", "swansea", "newport", "wales", "welsh", "cymru", "wrexham", "bangor",
               "aberystwyth"]),
    ("Northern Ireland", ["belfast", "northern ireland", "derry", "lisburn", "newry", "armagh"]),
]

# Postcode area -> region, in declared order. DN and SY appear twice; the later
# entry wins, as in a literal dictionary.
POSTCODE_AREAS = [
    ("E", "London"), ("EC", "London"), ("N", "London"), ("NW", "London"),
    ("SE", "London"), ("SW", "London"), ("W", "London"), ("WC", "London"),
    ("BR", "South East"), ("CR", "South East"), ("DA", "South East"), ("GU", "South East"),
    ("KT", "South East"), ("ME", "South East"), ("RG", "South East"), ("RH", "South East"),
    ("SL", "South East"), ("SM", "South East"), ("TN", "South East"), ("TW", "South East"),
    ("OX", "South East"), ("HP", "South East"), ("MK", "South East"), ("BN", "South East"),
    ("PO", "South East"), ("SO", "South East"), ("SP", "South East"),
    ("BA", "South West"), ("BS", "South West"), ("DT", "South West"), ("EX", "South West"),
    ("GL", "South West"), ("PL", "South West"), ("TA", "South West"), ("TQ", "South West"),
    ("TR", "South West"), ("SN", "South West"),
    ("CB", "East of England"), ("CM", "East of England"), ("CO", "East of England"),
    ("IP", "East of England"), ("LU", "East of England"), ("NR", "East of England"),
    ("PE", "East of England"), ("SG", "East of England"), ("SS", "East of England"),
    ("DE", "East Midlands"), ("DN", "East Midlands"), ("LE", "East Midlands"),
    ("LN", "East Midlands"), ("NG", "East Midlands"), ("NN", "East Midlands"),
    ("B", "West Midlands"), ("CV", "West Midlands"), ("DY", "West Midlands"),
    ("HR", "West Midlands"), ("ST", "West Midlands"), ("SY", "West Midlands"),
    ("TF", "West Midlands"), ("WR", "West Midlands"), ("WS", "West Midlands"),
    ("WV", "West Midlands"),
    ("BD", "Yorkshire and the Humber"), ("DN", "Yorkshire and the Humber"),
    ("HD", "Yorkshire and the Humber"), ("HG", "Yorkshire and the Humber"),
    ("HU", "Yorkshire and the Humber"), ("HX", "Yorkshire and the Humber"),
    ("LS", "Yorkshire and the Humber"), ("S", "Yorkshire and the Humber"),
    ("WF", "Yorkshire and the Humber"), ("YO", "Yorkshire and the Humber"),
    ("BL", "North West"), ("CA", "North West"), ("CH", "North West"),
    ("CW", "North West"), ("FY", "North West"), ("L", "North West"),
    ("LA", "North West"), ("M", "North West"), ("OL", "North West"),
    ("PR", "North West"), ("SK", "North West"), ("WA", "North West"),
    ("WN", "North West"),
    ("DH", "North East"), ("DL", "North East"), ("NE", "North East"),
    ("SR", "North East"), ("TS", "North East"),
    ("AB", "Scotland"), ("DD", "Scotland"), ("DG", "Scotland"), ("EH", "Scotland"),
    ("FK", "Scotland"), ("G", "Scotland"), ("HS", "Scotland"), ("IV", "Scotland"),
    ("KA", "Scotland"), ("KW", "Scotland"), ("KY", "Scotland"), ("ML", "Scotland"),
    ("PA", "Scotland"), ("PH", "Scotland"), ("TD", "Scotland"), ("ZE", "Scotland"),
    ("CF", "Wales"), ("LD", "Wales"), ("LL", "Wales"), ("NP", "Wales"),
    ("SA", "Wales"), ("SY", "Wales"),
    ("BT", "Northern Ireland"),
]

# Fixed value: a UK postcode; group 1 is the outward code.
POSTCODE_PATTERN = r"\b([A-Z]{1,2}\d{1,2}[A-Z]?)\s*\d[A-Z]{2}\b"

UNKNOWN = "Unknown"


def postcode_map() -> dict[str, str]:
    """Area -> region with later duplicates winning."""
    return dict(POSTCODE_AREAS)


def city_map() -> dict[str, str]:
    """Keyword -> region, the first region in declared order winning for a repeated keyword
    (the same answer as scanning the regions in order)."""
    out: dict[str, str] = {}
    for region, words in UK_REGIONS:
        for w in words:
            out.setdefault(w, region)
    return out


def _map_literal(d: dict[str, str]) -> Column:
    """A MAP<STRING,STRING> literal, passed to the JVM as one SQL expression."""
    def q(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{q(k)}, {q(v)}" for k, v in d.items()) + ")")


def _keyword_regex(words) -> str:
    """Alternation of the literal keywords, led by a look-ahead on their first letters: the
    same language, but positions that cannot start a keyword are skipped without trying
    every alternative (about twice as fast in Java's regex engine)."""
    for w in words:
        if not w or not all(ch.isalnum() or ch == " " for ch in w) or not w[0].isalnum():
            raise ValueError(f"keyword needs escaping: {w!r}")
    first = "".join(sorted({w[0] for w in words}))
    return f"(?=[{first}])(?:" + "|".join(words) + ")"


def postcode_outward(c) -> Column:
    """Outward code of the first postcode in the upper-cased text, one trailing letter
    dropped (``SW1A 1AA`` -> ``SW1``); null when there is none."""
    up = F.upper(col_of(c))
    outward = F.regexp_extract(up, "(?U)" + POSTCODE_PATTERN, 1)
    return F.nullif(F.regexp_replace(outward, "[A-Z]$", ""), F.lit(""))


def region_from_postcode(c, mode: str = "reference") -> Column:
    """Region of the address's postcode.

    ``mode='reference'`` looks the outward code up as is (it always ends in a digit, so it
    never matches the letter-only table: SURVEY S11a); ``'area'`` looks up its leading
    letters, the documented intent."""
    out = postcode_outward(c)
    key = out if mode == "reference" else F.nullif(F.regexp_extract(out, "^[A-Z]+", 0), F.lit(""))
    return F.try_element_at(_map_literal(postcode_map()), key)


def region_from_city(c) -> Column:
    """Exact match of the second comma-separated part (lower-cased, stripped) against each
    region's keywords, first region in declared order wins; null if none. One hash-map probe
    per row."""
    s = trim_ws(col_of(c))
    city = F.lower(trim_ws(F.get(F.split(s, ","), 1)))
    return city_lookup(s, city)


def city_lookup(trimmed: Column, city: Column) -> Column:
    return F.when(trimmed.contains(",") & (city != ""), F.try_element_at(_map_literal(city_map()), city))


def region_from_keyword(c) -> Column:
    """First region (declared order) with any keyword contained in the lower-cased text."""
    return keyword_lookup(F.lower(trim_ws(col_of(c))))


def keyword_lookup(low: Column) -> Column:
    """``region_from_keyword`` on text that is already stripped and lower-cased."""
    expr = None
    for region, words in UK_REGIONS:
        cond = low.rlike(_keyword_regex(words))
        expr = F.when(cond, F.lit(region)) if expr is None else expr.when(cond, F.lit(region))
    return expr


def region_from_address(c, postcode_mode: str = "reference") -> Column:
    """City -> postcode -> keyword -> ``'Unknown'``; null or empty address -> ``'Unknown'``."""
    c = col_of(c)
    found = F.coalesce(region_from_city(c), region_from_postcode(c, postcode_mode),
                       region_from_keyword(c))
    return F.when(c.isNull() | (c == ""), F.lit(UNKNOWN)).otherwise(F.coalesce(found, F.lit(UNKNOWN)))


def region_from_locations(c, postcode_mode: str = "reference") -> Column:
    """Pipe-separated locations: the first (in list order) whose region is not Unknown.

    A value without ``|`` is one location and takes the plain (code-generated) address
    expression; only real lists go through the higher-order ``transform``/``filter``.
    """
    c = col_of(c)
    regions = F.transform(F.split(c, r"\|"),
                          lambda loc: region_from_address(trim_ws(loc), postcode_mode))
    known = F.filter(regions, lambda r: r != F.lit(UNKNOWN))
    listed = F.coalesce(F.get(known, 0), F.lit(UNKNOWN))
    single = region_from_address(trim_ws(c), postcode_mode)
    return (F.when(c.isNull() | (c == ""), F.lit(UNKNOWN))
             .when(~c.contains("|"), single)
             .otherwise(listed))
