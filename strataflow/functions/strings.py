"""Columns that read names, wells, quantities, dates and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The power of ten of each prefix.
PREFIXES = {"p": -12, "n": -9, "µ": -6, "u": -6, "m": -3, "": 0, "k": 3}


def well(text: Column) -> Column:
    """Struct of row and column (from 1) of names like A1, a-01 or R01C08; null for others."""
    t = F.upper(F.trim(text))
    letters, number = F.regexp_extract(t, r"^([A-Z]{1,2})[ _-]?0*([0-9]+)$", 1), F.regexp_extract(t, r"^([A-Z]{1,2})[ _-]?0*([0-9]+)$", 2)
    row, column = F.regexp_extract(t, r"^R([0-9]+)C([0-9]+)$", 1), F.regexp_extract(t, r"^R([0-9]+)C([0-9]+)$", 2)
    index = F.when(F.length(letters) == 1, F.ascii(letters) - 64).when(F.length(letters) == 2, (F.ascii(letters) - 64) * 26 + F.ascii(F.substring(letters, 2, 1)) - 64)
    return F.when(letters != "", F.struct(index.cast("int").alias("row"), number.cast("int").alias("column"))).when(row != "", F.struct(row.cast("int").alias("row"), column.cast("int").alias("column")))


def well_name(row: Column, column: Column) -> Column:
    letters = F.when(row <= 26, F.char(row + 64)).otherwise(F.concat(F.char(F.floor((row - 1) / 26) + 64), F.char((row - 1) % 26 + 65)))
    return F.concat(letters, F.lpad(column.cast("string"), 2, "0"))


def quantity(text: Column) -> Column:
    """Struct of number, unit and the number in base units of texts like '10 nM'; null for others."""
    pattern = r"^\s*([0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*([pnµumk]?)([A-Za-z%/]+)\s*$"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".")
    prefix, unit = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)
    power = F.create_map(*[F.lit(x) for k, v in PREFIXES.items() for x in (k, float(10.0**v))])
    value = F.when(number != "", number).try_cast("double")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.concat(prefix, unit).alias("unit"), (value * F.try_element_at(power, prefix)).alias("base")))


def acquired(date: Column, clock: Column) -> Column:
    """Timestamp of '01-JAN-2019' and '00:41:09'; null when either can't be read."""
    return F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.lower(date)), F.substring(clock, 1, 8)), F.lit("dd-MMM-yyyy HH:mm:ss"))


def normalised(name: Column) -> Column:
    """Lower case letters and digits of a name without its file extension."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,4}$", "")), r"[^\p{L}\p{N}]", "")


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits order by their number: each is padded to `width`."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def role(name: Column) -> Column:
    """Kind of a sample guessed from its name."""
    n = F.lower(name)
    return (
        F.when(n.rlike(r"unstained|\bus\b"), "unstained")
        .when(n.rlike(r"\bfmo\b"), "fmo")
        .when(n.rlike(r"single|\bcomp"), "single stain")
        .when(n.rlike(r"bead|rainbow"), "beads")
        .when(n.rlike(r"blank|vehicle|dmso|\bneg"), "control")
        .otherwise("sample")
    )


def dilution(text: Column) -> Column:
    """Factor of texts like '1:10' or '10'; null for others and for 0."""
    value = F.regexp_replace(F.regexp_extract(text, r"^\s*(?:1\s*:\s*)?([0-9]+(?:[.,][0-9]+)?)\s*$", 1), ",", ".")
    number = F.when(value != "", value).try_cast("double")
    return F.when(number > 0, number)


def amount(name: Column) -> Column:
    """Struct of number and unit of the last amount in a name, such as '0.5 ug' in 'CD3_0.5ug.fcs' or '450 V'; null without one."""
    pattern = r"(?i)([0-9]+(?:[.,][0-9]+)?)[ _]?(ul|µl|ml|ug|µg|ng|mg|um|µm|nm|mm|min|v)(?![A-Za-z0-9])"
    numbers, units = F.regexp_extract_all(name, F.lit(pattern), F.lit(1)), F.regexp_extract_all(name, F.lit(pattern), F.lit(2))
    number = F.regexp_replace(F.try_element_at(numbers, F.lit(-1)), ",", ".").try_cast("double")
    return F.when(number.isNotNull(), F.struct(number.alias("value"), F.lower(F.try_element_at(units, F.lit(-1))).alias("unit")))


# lasers' wavelengths and the letters that name their detectors.
LASERS = {"UV": 355, "V": 405, "B": 488, "YG": 561, "R": 640, "IR": 808}


def detector(name: Column) -> Column:
    """Struct of laser, number in its row, kind of measure (A, H, W) and a sort key of spectral detector names like 'YG3-A'; null for others."""
    pattern = "^(UV|IR|YG|V|B|R)([0-9]{1,2})(?:-([AHW]))?$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    wave = F.create_map(*[F.lit(x) for pair in LASERS.items() for x in pair])
    number = part(2).try_cast("int")
    return F.when(part(1) != "", F.struct(part(1).alias("laser"), number.alias("number"), F.nullif(part(3), F.lit("")).alias("measure"), (F.try_element_at(wave, part(1)) * 100 + number).alias("order")))


def channel_kind(name: Column, label: Column) -> Column:
    """time, scatter, mass or fluorescence, from a channel's names."""
    n = F.upper(F.concat_ws(" ", name, label))
    return F.when(n.rlike(r"^TIME\b"), "time").when(n.rlike(r"\b[FS]SC\b|\b[FS]SC-"), "scatter").when(n.rlike(r"^[A-Z]{1,2}[0-9]{2,3}DI\b"), "mass").otherwise("fluorescence")


def marker(label: Column) -> Column:
    """The marker in a label such as 'CD4 BV421' or 'CD4-BV421': what stands before the dye; null for a blank label."""
    text = F.trim(F.regexp_replace(label, r"(?i)[ _:-]+(FITC|PE|APC|BV[0-9]+|BUV[0-9]+|AF[0-9]+|PerCP|Alexa).*$", ""))
    return F.nullif(text, F.lit(""))
