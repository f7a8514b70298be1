"""Standardisation rules of the job-market branch, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: outputs must equal these labels, and the first match wins. ---

WORK_MODES = (
    ("office|onsite|at office|at the office", "At Office"),
    ("hybrid|mix|partly|part-time", "Hybrid"),
    ("remote|home|work from home|wfh", "Remote"),
)
WORK_MODE_DEFAULT = "At Office"

CITIES = (
    ("hcm", "Ho Chi Minh"),
    ("hochiminh", "Ho Chi Minh"),
    ("tp.hcm", "Ho Chi Minh"),
    ("hanoi", "Ha Noi"),
    ("ha noi", "Ha Noi"),
    ("da nang", "Da Nang"),
)
CITY_SEPARATOR = " - "

REGIONS = (
    ("Ha Noi", "Bắc"),
    ("Da Nang", "Trung"),
    ("Ho Chi Minh", "Nam"),
)
REGION_DEFAULT = "Khác"
COUNTRY = "Vietnam"

SKILL_NOISE = r"[\[\]']"
SKILL_SEPARATOR = r",\s*"

SKILL_GROUPS = (
    ("PYTHON|DATA|SPARK|SQL", "Data/Backend"),
    ("AWS|DEVOPS|DOCKER|KUBERNETES", "DevOps/Cloud"),
    ("REACT|ANGULAR|FRONTEND|VUE", "Frontend"),
)

CATEGORY_GROUPS = (
    ("Data|Analytics|BI", "Data & Analytics"),
    ("Backend|Frontend|Fullstack|Software|Engineer", "Software Engineering"),
    ("DevOps|Cloud|SRE|SysOps", "DevOps / Cloud / Infra"),
    ("AI|Machine Learning|Computer Vision|Deep Learning", "AI & ML"),
    ("Security|Pentest|Cyber", "Security"),
    ("Manager|Director|C-level|Lead", "Management"),
    ("Tester|QA", "QA / Testing"),
)
GROUP_DEFAULT = "Other"

# --- End of fixed values. ---


def first_match(tests: Iterable[tuple[Column, str]], default: Column | str) -> Column:
    """Label of the first test that holds, else ``default`` (NULL tests do not hold)."""
    chain = None
    for test, label in tests:
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(default)


def work_mode(raw: Column) -> Column:
    text = F.trim(F.lower(raw))
    return first_match(((text.rlike(rx), label) for rx, label in WORK_MODES), WORK_MODE_DEFAULT)


def city(raw: Column) -> Column:
    """One location entry: trimmed, with the known spellings unified."""
    entry = F.trim(raw)
    lowered = F.lower(entry)
    return first_match(((lowered.contains(part), label) for part, label in CITIES), entry)


def cities(raw: Column) -> Column:
    """All entries of a location text in listed order; blank ones included."""
    return F.transform(F.split(F.trim(raw), CITY_SEPARATOR), city)


def first_city(raw: Column) -> Column:
    """The first entry that is not blank, NULL when there is none."""
    return F.get(F.filter(cities(raw), lambda c: c != ""), F.lit(0))


def skills(raw: Column) -> Column:
    """Upper-cased skill list without brackets, quotes and empty entries."""
    parts = F.split(F.regexp_replace(F.lower(raw), SKILL_NOISE, ""), SKILL_SEPARATOR)
    trimmed = F.transform(parts, lambda s: F.upper(F.trim(s)))
    return F.filter(trimmed, lambda s: s != "")


def region(city_name: Column) -> Column:
    return first_match(((city_name == c, label) for c, label in REGIONS), REGION_DEFAULT)


def skill_group(skill_name: Column) -> Column:
    return first_match(((skill_name.rlike(rx), g) for rx, g in SKILL_GROUPS), GROUP_DEFAULT)


def category_name(raw: Column) -> Column:
    return F.initcap(F.trim(raw))


def category_group(name: Column, case_insensitive: bool = False) -> Column:
    """Group of a category name.

    Names are title-cased, so all-capital patterns such as ``AI`` never match by
    default; ``case_insensitive=True`` lets them.
    """
    flag = "(?i)" if case_insensitive else ""
    return first_match(((name.rlike(flag + rx), g) for rx, g in CATEGORY_GROUPS), GROUP_DEFAULT)


def filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")
