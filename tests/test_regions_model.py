"""Region parsing against a plain-Python model of the rules in SURVEY 2.C / S11-S12, on
generated addresses (cities, keywords inside other words, postcodes, commas, pipes, blanks)."""

import random
import re

import pytest

from vacancy_spark.functions.regions import (POSTCODE_PATTERN, UK_REGIONS, postcode_map,
                                             region_from_address, region_from_locations)


def model_address(addr, mode="reference"):
    if addr is None or addr == "":
        return "Unknown"
    s = addr.strip()
    low = s.lower()
    if "," in s:
        city = s.split(",")[1].strip().lower()
        if city:
            for region, words in UK_REGIONS:
                if city in words:
                    return region
    m = re.search(POSTCODE_PATTERN, addr.upper())
    if m:
        outward = re.sub(r"[A-Z]$", "", m.group(1))
        key = outward if mode == "reference" else (re.match(r"[A-Z]+", outward) or [None])[0]
        if key in postcode_map():
            return postcode_map()[key]
    for region, words in UK_REGIONS:
        if any(w in low for w in words):
            return region
    return "Unknown"


def model_locations(value, mode="reference"):
    if value is None or value == "":
        return "Unknown"
    for loc in value.split("|"):
        r = model_address(loc.strip(), mode)
        if r != "Unknown":
            return r
    return "Unknown"


PIECES = ["London", "leeds", " Kent", "stoke", "Derby", "derbyshire", "Nowhere", "Paris", "FR",
          "GB", "England", "Wales", "cardiff", "e1", "SW1A 1AA", "LE1 5YA", "M1 1AE", "DN1 2AB",
          "SY1 1AA", "BT1 1AA", "1 High St", "ec2", "  ", "", "Tyne and Wear", "Perth", "x"]


def gen_address(rnd):
    n = rnd.randrange(1, 5)
    sep = rnd.choice([", ", ",", " ", " , "])
    return sep.join(rnd.choice(PIECES) for _ in range(n))


@pytest.mark.parametrize("seed", [11, 12])
def test_region_expressions_match_model(spark, seed):
    rnd = random.Random(seed)
    addrs = [gen_address(rnd) for _ in range(300)] + [None, "", "   "]
    lists = [" | ".join(gen_address(rnd) for _ in range(rnd.randrange(1, 4))) for _ in range(200)]
    df = spark.createDataFrame([(a,) for a in addrs + lists], "a string")
    got = df.select("a", region_from_address("a").alias("ref"),
                    region_from_address("a", "area").alias("area"),
                    region_from_locations("a").alias("loc")).collect()
    for r in got:
        assert r["ref"] == model_address(r["a"]), r["a"]
        assert r["area"] == model_address(r["a"], "area"), r["a"]
        assert r["loc"] == model_locations(r["a"]), r["a"]
