"""Precise-orbit files (SP3): names, choice of product, parsing."""

from __future__ import annotations

import datetime
import os
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Where each product lies on its archive, and what its files are called.
PRODUCTS = {
    "final": ("http://navigation-office.esa.int/products/gnss-products/", "ESA0MGNFIN_{date}0000_01D_05M_ORB.SP3.gz"),
    "rapid": ("ftp://ftp.gfz-potsdam.de/GNSS/products/mgnss/", "GBM0MGXRAP_{date}0000_01D_05M_ORB.SP3.gz"),
    "ultra": ("http://navigation-office.esa.int/products/gnss-products/", "esu{week}{day}_00.sp3.Z"),
}
PRIORITY = ("final", "rapid", "ultra")


def file_name(date: str, product: str = "final") -> str:
    """Name of a product's file for a date (YYYYDDD)."""
    week, day = week_and_day(date)
    return PRODUCTS[product][1].format(date=date, week=week, day=day)


def url(date: str, product: str = "final") -> str:
    return f"{PRODUCTS[product][0]}{week_and_day(date)[0]}/{file_name(date, product)}"


def week_and_day(date: str) -> tuple[int, int]:
    day = datetime.date(int(date[:4]), 1, 1) + datetime.timedelta(int(date[4:]) - 1)
    return divmod((day - datetime.date(1980, 1, 6)).days, 7)


def fetch(date: str, folder: str, product: str = "final") -> str:
    """Path of a file in a local folder; fetched from its archive where it isn't there yet (needs a network)."""
    path = os.path.join(folder, file_name(date, product))
    if not os.path.exists(path):
        from urllib.request import urlretrieve

        urlretrieve(url(date, product), path)
    return path


def available(date: str, folder: str) -> str | None:
    """The best product whose file for a date is in a local folder."""
    return next((p for p in PRIORITY if os.path.exists(os.path.join(folder, file_name(date, p)))), None)


def read_available(spark: SparkSession, folder: str, dates: list[str]) -> DataFrame:
    """Epochs of the named dates from a local folder, each from the best product that is there; a warning names dates without one, and those that fall back."""
    found = {d: available(d, folder) for d in dates}
    for wrong, what in ((sorted(d for d, p in found.items() if p is None), "have no orbits"), (sorted(d for d, p in found.items() if p not in (None, PRIORITY[0])), "have no final orbits, so that others are taken")):
        if wrong:
            warnings.warn(f"{', '.join(wrong)} {what}", stacklevel=2)
    paths = [os.path.join(folder, file_name(d, p)) for d, p in found.items() if p]
    return parse(spark, paths).filter(F.col("date").isin(dates)) if paths else spark.createDataFrame([], SCHEMA)


SCHEMA = "epoch bigint, date string, time bigint, svid string, x double, y double, z double, clockerror double"


def best_product(orbits: DataFrame, product: str = "product") -> DataFrame:
    """Of rows for the same date and satellite epoch, those of the best product."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col(product))
    best = orbits.groupBy("date").agg(F.min(rank).alias("__best"))
    return orbits.join(best, "date").filter(rank == F.col("__best")).drop("__best")


def parse(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(epoch, date, time, svid, x, y, z, clockerror) of the files at a path, compressed by gzip or not.

    Metres and nanoseconds; whole seconds; the epoch's line stands before its satellites' lines. Files that end in ``.Z`` are read as well.
    """
    plain = spark.read.text(path).filter(~F.col("_metadata.file_path").endswith(".Z")).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value")
    packed = spark.read.format("binaryFile").load(path).filter(F.col("path").endswith(".Z")).select(F.col("path").alias("file"), unpacked(F.col("content")).alias("body"))
    old = packed.select("file", F.posexplode(F.split("body", r"\r?\n")).alias("n", "value")).select("file", F.col("n").cast("long"), "value")
    return parse_lines(plain.unionByName(old))


def lzw(data: bytes) -> bytes:
    """What a ``.Z`` file holds: codes of growing width, low bits first, in blocks of eight codes of one width; code 256 empties the table where the header says so."""
    if data[:2] != b"\x1f\x9d":
        raise ValueError("not a .Z file")
    most, clears = data[2] & 31, bool(data[2] & 128)
    first = 257 if clears else 256
    table = [bytes([k]) for k in range(256)] + [b""] * (first - 256)
    out, before, width, at, begun = [], b"", 9, 24, 24

    def aligned(at: int) -> int:
        """Where the next block begins: a change of width or an emptied table leaves the rest of a block unused."""
        return begun + -(-(at - begun) // (8 * width)) * 8 * width

    while at + width <= 8 * len(data):
        code = int.from_bytes(data[at >> 3 : (at + width + 7) >> 3], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if code == 256 and clears:
            at = begun = aligned(at)
            del table[first:]
            before, width = b"", 9
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("a .Z file that is damaged")
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before and len(table) < 1 << most:
            table.append(before + word[:1])
        before = word
        if len(table) + 1 > 1 << width and width < most:
            at = begun = aligned(at)
            width += 1
    return b"".join(out)


def unpacked(content: Column) -> Column:
    """Text of ``.Z`` files; they are small, and Spark has no reader for them."""

    @F.pandas_udf("string")
    def text(files: pd.Series) -> pd.Series:
        return files.map(lambda b: lzw(bytes(b)).decode("ascii", "replace"))

    return text(content)


def parse_lines(text: DataFrame) -> DataFrame:
    """The same from lines of text: (file, n, value), n growing within a file."""
    kept = text.filter(F.col("value").rlike(r"^(\*  ?|P)"))
    order = Window.partitionBy("file").orderBy("n")
    is_epoch = F.col("value").startswith("*")
    kept = kept.withColumns({"stamp": F.last(F.when(is_epoch, F.col("value")), True).over(order), "epoch": F.sum(is_epoch.cast("int")).over(order) - 1})
    part = F.split(F.trim(F.substring("stamp", 2, 60)), r"\s+")
    piece = lambda i: F.get(part, F.lit(i)).try_cast("int")
    day = F.make_date(piece(0), piece(1), piece(2))
    seconds = F.floor(F.get(part, F.lit(5)).try_cast("double")).cast("long")
    number = lambda at: F.trim(F.substring("value", at, 14)).try_cast("double") * F.lit(1000.0)
    rows = kept.filter(F.col("value").startswith("P") & F.col("stamp").isNotNull())
    return rows.select(
        F.col("epoch").cast("long"),
        F.concat(F.year(day).cast("string"), F.lpad(F.dayofyear(day).cast("string"), 3, "0")).alias("date"),
        (((piece(3) * 3600 + piece(4) * 60).cast("long") + seconds) * F.lit(10**9).cast("long")).alias("time"),
        F.replace(F.substring("value", 2, 3), F.lit(" "), F.lit("0")).alias("svid"),
        number(5).alias("x"), number(19).alias("y"), number(33).alias("z"), number(47).alias("clockerror"),
    )


def write(orbits: DataFrame, path: str) -> None:
    """Writes an SP3 table as text, in the layout that ``parse`` reads: one file for each date."""
    hour = "lpad(string(int(time div 3600000000000)), 2, ' '), ' ', lpad(string(int(time div 60000000000 % 60)), 2, ' '), ' ', lpad(format_number(time div 1000000000 % 60, '0.00000000'), 11, ' ')"
    day = F.expr("date_add(make_date(int(substring(date, 1, 4)), 1, 1), int(substring(date, 5, 3)) - 1)")
    lines = orbits.withColumn("day", day).withColumns({
        "head": F.expr(f"concat('*  ', date_format(day, 'yyyy'), ' ', lpad(string(month(day)), 2, ' '), ' ', lpad(string(day(day)), 2, ' '), ' ', {hour})"),
        "body": F.expr("concat('P', svid, " + ", ".join(f"lpad(format_number({c} / 1000, '0.000000'), 14, ' ')" for c in ("x", "y", "z", "clockerror")) + ")"),
    })
    grouped = lines.groupBy("date", "epoch").agg(F.first("head").alias("head"), F.sort_array(F.collect_list("body")).alias("bodies"))
    text = grouped.repartition("date").sortWithinPartitions("date", "epoch").select("date", F.explode(F.concat(F.array("head"), F.col("bodies"))).alias("value"))
    text.write.mode("overwrite").partitionBy("date").text(path)
