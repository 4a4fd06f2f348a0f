"""Mutations of persons and their faces. Each returns new snapshots; nothing is changed in place.

persons: person_id, library, alias, display_name, face_count, prototype_face_id and further columns. faces: face_id, asset_id,
person_id, quality and further columns. Faces carry no library, so a mutation of faces reaches a person_id in every library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _recounted(persons: DataFrame, faces: DataFrame, touched: Column, keep_empty: bool = False) -> DataFrame:
    """Counts and prototypes (best quality, then smallest face_id) of the touched persons follow their faces."""
    held = faces.groupBy("person_id").agg(F.count("*").alias("_n"), F.min(F.struct(-F.col("quality"), "face_id"))["face_id"].alias("_best"))
    rows = persons.join(held, "person_id", "left")
    if not keep_empty:
        rows = rows.filter(F.col("_n").isNotNull() | ~touched)
    count = F.when(touched, F.coalesce("_n", F.lit(0))).otherwise(F.col("face_count")).cast(persons.schema["face_count"].dataType)
    best = F.when(touched, F.col("_best")).otherwise(F.col("prototype_face_id"))
    return rows.withColumns({"face_count": count, "prototype_face_id": best}).select(*persons.columns)


def _is(person_ids: list[str], library: str) -> Column:
    return F.col("person_id").isin(person_ids) & (F.col("library") == library)


def rename(persons: DataFrame, person_id: str, name: str, library: str = "personal") -> DataFrame:
    """Both names become the trimmed name, or null where it is blank; an unknown person is a ValueError."""
    here = _is([person_id], library)
    if persons.filter(here).isEmpty():
        raise ValueError(f"no person {person_id} in library {library}")
    new = F.lit(name.strip() or None).cast("string")
    return persons.withColumns({c: F.when(here, new).otherwise(F.col(c)) for c in ("alias", "display_name")})


def merge(persons: DataFrame, faces: DataFrame, target: str, sources: list[str], library: str = "personal") -> tuple[DataFrame, DataFrame]:
    """The sources' faces go to the target, which is counted anew and stays even without faces. Without sources nothing changes."""
    sources = [p for p in sources if p and p != target]
    if not sources:
        return persons, faces
    moved = faces.withColumn("person_id", F.when(F.col("person_id").isin(sources), target).otherwise(F.col("person_id")))
    return _recounted(persons.filter(~_is(sources, library)), moved, _is([target], library), keep_empty=True), moved


def delete(persons: DataFrame, faces: DataFrame, person_id: str, library: str = "personal") -> tuple[DataFrame, DataFrame]:
    return persons.filter(~_is([person_id], library)), faces.filter(F.col("person_id") != person_id)


def remove_from_asset(persons: DataFrame, faces: DataFrame, asset_id: str, person_id: str, library: str = "personal") -> tuple[DataFrame, DataFrame]:
    """A person without faces left goes."""
    left = faces.filter((F.col("asset_id") != asset_id) | (F.col("person_id") != person_id))
    return _recounted(persons, left, _is([person_id], library)), left


def clean_up(persons: DataFrame, faces: DataFrame, assets: DataFrame, library: str = "personal") -> tuple[DataFrame, DataFrame]:
    """Faces of assets that are gone go; all persons of the library are counted anew, and go without faces."""
    left = faces.join(assets.select("asset_id"), "asset_id", "left_semi").select(*faces.columns)
    return _recounted(persons, left, F.col("library") == library), left


def replace_library(persons: DataFrame, faces: DataFrame, new_persons: DataFrame, new_faces: DataFrame, library: str = "personal") -> tuple[DataFrame, DataFrame]:
    """New clusters take a library's place; a person without a name keeps the one that its id had."""
    old = persons.filter(F.col("library") == library)
    names = old.select("person_id", F.col("alias").alias("_alias"), F.col("display_name").alias("_name"))
    named = new_persons.join(names, "person_id", "left").withColumns(
        {
            "library": F.lit(library),
            "alias": F.coalesce(F.nullif("alias", F.lit("")), "_alias"),
            "display_name": F.coalesce(F.nullif("display_name", F.lit("")), "_name"),
        }
    )
    rest = faces.join(old.select("person_id"), "person_id", "left_anti").select(*faces.columns)
    return persons.filter(F.col("library") != library).unionByName(named.select(*persons.columns)), rest.unionByName(new_faces)


def delete_asset(asset_id: str, *tables: DataFrame) -> list[DataFrame]:
    """The asset's rows go from every table given; persons keep their counts until they are cleaned up."""
    return [t.filter(F.col("asset_id") != asset_id) for t in tables]
