"""Deterministic keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of all entity keys. Fixed value.
NAMESPACE = "00000000-0000-4000-8000-00000000beef"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5: SHA-1 over namespace and name, 16 bytes, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    laid_out = F.regexp_replace(h, "^(.{8})(.{4}).(.{3})(.{4})(.{12}).*$", "$1-$2-5$3-$4-$5")
    return F.overlay(laid_out, F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), 20, 1)


def entity_key(kind: str | Column, ext_id: Column) -> Column:
    """uuid5 of ``kind:ext_id``: stubs and full rows of one entity get one key. Null id: null."""
    return uuid5(key_name(kind, ext_id))


def key_name(kind: str | Column, ext_id: Column) -> Column:
    """What an entity key is made of: far shorter when it is compressed, and equal where keys are."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit(":"), ext_id.cast("string"))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def statement_key(language: Column, text: Column) -> Column:
    """16 hex characters over language and text."""
    return F.substring(F.sha2(F.concat(language, F.lit("::"), text), 256), 1, 16)
