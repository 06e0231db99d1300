"""Identities and hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUL = "\0"


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def hash_fields(*fields: Column) -> Column:
    """SHA-256 of NUL-joined field texts; NULL hashes like the empty text."""
    return F.sha2(F.concat_ws(NUL, *[_text(f) for f in fields]), 256)


def logical_id(*fields: Column) -> Column:
    return hash_fields(*fields)


def trial_id(logical: Column, attempt: Column) -> Column:
    """Identity of one attempt of a logical trial."""
    return hash_fields(logical, attempt)


def seeded_key(*fields: Column) -> Column:
    """Order key for reproducible shuffles; independent of partitioning."""
    return hash_fields(*fields)


def instance_id(family: Column, instance: Column) -> Column:
    return F.concat_ws("::", family, instance)


def role_hash(prefix: str, roles: dict[str, Column]) -> Column:
    """SHA-256 of ``prefix NUL`` then ``role NUL raw-digest`` for each role."""
    parts = [F.lit(prefix + NUL).cast("binary")]
    for role, digest in roles.items():
        parts += [F.lit(role + NUL).cast("binary"), F.unhex(digest)]
    return F.sha2(F.concat(*parts), 256)


def semantic_hash(files: Column) -> Column:
    """SHA-256 of the (role, sha256, size) list as canonical JSON, paths ignored."""
    items = F.transform(
        files,
        lambda f: F.struct(
            f["role"].alias("role"), f["sha256"].alias("sha256"),
            f["size_bytes"].alias("size_bytes"),
        ),
    )
    return F.sha2(F.to_json(items), 256)


def same_inputs(first: Column, second: Column) -> Column:
    """Equality of two file lists by role, digest and size, in role order."""

    def shape(files: Column) -> Column:
        return F.array_sort(
            F.transform(files, lambda f: F.struct(f["role"], f["sha256"], f["size_bytes"]))
        )

    return shape(first).eqNullSafe(shape(second)) & first.isNotNull()


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def canonical_id_udf():
    """Arrow UDF: SHA-256 of sorted-key compact JSON, for identities of old records.

    Number texts follow the writer of those records (``1e-08``), which Spark's
    ``to_json`` (``1.0E-8``) cannot reproduce; new identities use :func:`trial_id`.
    """
    @F.pandas_udf(T.StringType())
    def canonical_id(documents: pd.Series) -> pd.Series:
        import hashlib
        import json

        def digest(text):
            if text is None:
                return None
            compact = json.dumps(
                json.loads(text), allow_nan=False, ensure_ascii=False,
                separators=(",", ":"), sort_keys=True,
            )
            return hashlib.sha256(compact.encode()).hexdigest()

        return documents.map(digest)

    return canonical_id


#: fixed value: names whose values never leave the machine in clear text
SENSITIVE_NAME = r"(?i)(?:TOKEN|PASSWORD|PASSWD|SECRET|CREDENTIAL|PRIVATE|API[_-]?KEY)"


def redact(environment: Column) -> Column:
    """Replace values of sensitive names by a short digest mark."""
    return F.transform_values(
        environment,
        lambda k, v: F.when(
            k.rlike(SENSITIVE_NAME),
            F.concat(F.lit("<redacted:sha256:"), F.substring(F.sha2(v, 256), 1, 12), F.lit(">")),
        ).otherwise(v),
    )
