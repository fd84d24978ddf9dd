"""Pages of ordered rows: by offset, by key, with a pinned head, with exact matches first, in several orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 20) -> DataFrame:
    """Rows offset to offset + limit in the order given, which must be total; a top-k, not a sort of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, key: str, id_column: str, after: tuple | None, limit: int) -> DataFrame:
    """The rows after a cursor (key, id), in falling order of the key and rising order of the id; nothing before it is read again."""
    if after is not None:
        k, i = after
        rows = rows.where((F.col(key) < F.lit(k)) | ((F.col(key) == F.lit(k)) & (F.col(id_column) > F.lit(i))))
    return rows.orderBy(F.desc(key), id_column).limit(limit)


def pinned_page(rows: DataFrame, order: list[str], pin: Column, offset: int, limit: int) -> DataFrame:
    """A page whose pinned row leads if it is the first one; later pages skip the pinned row, whose rank still counts as used.

    Adds pos (from 1) and next_offset. The window of ranks [offset, offset + limit) is consumed as far as there is room.
    """
    # only the ranks up to the window's end and the pinned row matter: two top-k plans, and windows over those few rows
    pinned = F.coalesce(pin, F.lit(False))
    head = rows.orderBy(*order).limit(offset + limit + 1).withColumns({"pinned": pinned, "lead": F.lit(0)})
    if offset == 0:
        head = head.unionAll(rows.where(pinned).orderBy(*order).limit(1).withColumns({"pinned": F.lit(True), "lead": F.lit(1)}))
    ranked = head.withColumn("rk", F.row_number().over(Window.partitionBy("lead").orderBy(*order)) - 1)
    inside = (F.col("lead") == 0) & F.col("rk").between(offset, offset + limit - 1)
    every = Window.orderBy("lead", "rk")
    counted = ranked.withColumns({"inside": inside, "leads": F.max("lead").over(Window.partitionBy()), "plain": F.sum((inside & ~F.col("pinned")).cast("int")).over(every)})
    used = counted.withColumn("used", F.col("inside") & (F.col("plain") <= F.lit(limit) - F.col("leads")))
    used = used.withColumn("next_offset", (F.sum(F.col("used").cast("int")).over(Window.partitionBy()) + offset).cast("int"))
    shown = used.where((F.col("lead") == 1) | (F.col("used") & ~F.col("pinned")))
    return shown.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("lead"), "rk"))).select(*rows.columns, "pos", "next_offset")


def exact_first(name: Column, query: str) -> Column:
    """0 for a name that is the query in any case, else 1."""
    return F.when(F.lower(name) == query.lower(), 0).otherwise(1)


def sort_modes(rows: DataFrame, modes: dict[str, list[Column | str]], limit: int, columns: list[str]) -> DataFrame:
    """The first rows in each of several orders, with the order's name and the place in it."""
    parts = []
    for name, order in modes.items():
        top = rows.orderBy(*order).limit(limit)
        parts.append(top.select(F.lit(name).alias("mode"), F.row_number().over(Window.orderBy(*order)).alias("pos"), *columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# fixed values: the fields by which the second corpus sorts
SORT_FIELDS = ("P_PDATE_D", "CITED", "AUTH_FIRST", "PUB_YEAR")
PREPRINTS = "PPR"


def corpus_order(sort: str | None, columns: dict[str, str], relevance: str, id_column: str, sources: list[str] | None = None) -> tuple[list[Column], str | None]:
    """The total order for a sort of the form `<field> asc|desc`, and a note where it is not the one asked for.

    columns: of the fields. Either direction has missing values last, ties go by id; without a sort, and for dates of preprints
    alone, which have none, the order is that of relevance. Other fields and directions are an error.
    """
    by_id, fallback = F.col(id_column).asc(), F.col(relevance).desc_nulls_last()
    if not sort or not sort.strip():
        return [fallback, by_id], None
    field, _, way = sort.strip().upper().partition(" ")
    if field not in SORT_FIELDS or way.strip() not in ("", "ASC", "DESC"):
        raise ValueError(f"sort: one of {', '.join(SORT_FIELDS)} with asc or desc")
    if field == "P_PDATE_D" and sources and all(s == PREPRINTS for s in sources):
        return [fallback, by_id], "Preprints have no publication date to sort by: the order is by relevance; PUB_YEAR sorts them by year."
    c = F.col(columns[field])
    return [c.asc_nulls_last() if way.strip() == "ASC" else c.desc_nulls_last(), by_id], None


def next_cursor(page: list, key: str, id_column: str, limit: int) -> tuple | None:
    """The cursor after a page that was read, or None at the end: a page that is not full is the last one."""
    return (page[-1][key], page[-1][id_column]) if len(page) == limit else None


def all_pages(rows: DataFrame, key: str, id_column: str, limit: int, most_pages: int) -> list:
    """The ids of up to most_pages pages, following the cursors; for clients that read on, not for whole tables."""
    out, after = [], None
    for _ in range(most_pages):
        page = keyset_page(rows, key, id_column, after, limit).collect()
        out += [r[id_column] for r in page]
        after = next_cursor(page, key, id_column, limit)
        if after is None:
            break
    return out
