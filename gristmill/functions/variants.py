"""Reading loosely typed JSON through VARIANT."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def is_array(value: Column, path: str) -> Column:
    return get(value, path, "array<variant>").isNotNull()


def is_object(value: Column, path: str) -> Column:
    return get(value, path, "map<string,variant>").isNotNull()


def text_if_string(value: Column, path: str) -> Column:
    """The value only if it is a JSON string. A plain cast would return the JSON of an object."""
    return F.when(F.schema_of_variant(get(value, path, "variant")) == "STRING", get(value, path))


def join_list_or_text(value: Column, path: str) -> Column:
    """An array of strings joined by ', ', or the string itself."""
    return F.coalesce(F.array_join(get(value, path, "array<string>"), ", "), get(value, path))


def items(value: Column, *paths: str, whole: bool = True) -> Column:
    """Rows of a payload: the payload itself if it is an array (unless `whole` is off), else the first
    non-empty array among the paths of the payload object."""
    nested = [F.when(F.size(get(value, p, "array<variant>")) > 0, get(value, p, "array<variant>")) for p in paths]
    return F.coalesce(*([get(value, "$", "array<variant>")] if whole else []), *nested)
