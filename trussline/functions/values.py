"""Value states, matrices and other row rules as columns."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trussline.model import DERIVED_FIDELITY, FIDELITY, VALUE_STATES

HEX64 = r"^[0-9a-f]{64}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
IDENTIFIER = r"^[A-Za-z][A-Za-z0-9._-]{0,127}$"
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"


def value_state_error(state: Column, has_value: Column, reason: Column) -> Column:
    """Code of the rule that a value state breaks, or null: known needs a value, all others a reason and no value."""
    return (
        F.when(state.isNull() | ~state.isin(*VALUE_STATES), "VALUE_STATE_INVALID")
        .when((state == "known") & ~has_value, "VALUE_STATE_VALUE_REQUIRED")
        .when((state != "known") & (F.coalesce(F.length(reason), F.lit(0)) == 0), "VALUE_STATE_REASON_REQUIRED")
        .when((state != "known") & has_value, "VALUE_STATE_VALUE_FORBIDDEN")
    )


def fidelity_error(kind: Column, derived: Column, sources: Column) -> Column:
    bad_sources = sources.isNull() | (F.size(sources) == 0) | F.exists(sources, lambda s: s.isNull() | (s == ""))
    return (
        F.when(kind.isNull() | ~kind.isin(*FIDELITY), "FIDELITY_CLASS_INVALID")
        .when(derived.isNull() | (kind.isin(*DERIVED_FIDELITY) & ~derived), "FIDELITY_DERIVATION_INVALID")
        .when(bad_sources, "FIDELITY_SOURCE_INVALID")
    )


def attestation_error(deterministic: Column, request: Column, response: Column, execution: Column, network: Column, provider: Column) -> Column:
    digests = F.coalesce(request.rlike(HEX64) & response.rlike(HEX64), F.lit(False))
    return (
        F.when(deterministic.isNull(), "ATTESTATION_INVALID")
        .when(~digests, "ATTESTATION_DIGEST_INVALID")
        .when(execution.isNull() | ~execution.isin("local", "network") | network.isNull() | ~network.isin("disabled", "allowlisted"), "ATTESTATION_INVALID")
        .when((execution == "network") & (network != "allowlisted"), "ATTESTATION_NETWORK_INVALID")
        .when(F.coalesce(F.length(provider), F.lit(0)) == 0, "ATTESTATION_INVALID")
    )


# Fixed values of the record format.
REPRODUCIBILITY = ("deterministic", "seeded", "non_deterministic")
VERIFICATION = ("unverified", "verified", "rejected")


def inference_error(digests: list[Column], confidences: list[Column], reproducibility: Column, provider: Column, version: Column, execution: Column, verification: Column) -> Column:
    """Code of the first rule that the metadata of an inference breaks, or null."""
    among = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    said = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    every = lambda tests: reduce(and_, tests)
    return (
        F.when(~every([F.coalesce(d.rlike(HEX64), F.lit(False)) for d in digests]), "INFERENCE_DIGEST_INVALID")
        .when(~every([F.coalesce(c.between(0, 1), F.lit(False)) for c in confidences]), "INFERENCE_CONFIDENCE_INVALID")
        .when(~among(reproducibility, REPRODUCIBILITY), "INFERENCE_REPRODUCIBILITY_INVALID")
        .when(~said(provider) | ~said(version), "INFERENCE_PROVIDER_INVALID")
        .when(~among(execution, ("local", "network")), "INFERENCE_EXECUTION_MODE_INVALID")
        .when(~among(verification, VERIFICATION), "INFERENCE_VERIFICATION_INVALID")
    )


def instant(text: Column) -> Column:
    """A UTC instant written with Z; null for any other text."""
    return F.when(text.rlike(INSTANT), F.try_to_timestamp(text))


def during(moment: Column, start: Column, end: Column) -> Column:
    """Whether a moment lies in the half-open interval [start, end)."""
    return (moment >= start) & (moment < end)


def matrix_product(left: Column, right: Column) -> Column:
    """Row-major 4x4 product of two arrays of 16."""
    cells = [sum((left[r * 4 + k] * right[k * 4 + c] for k in range(1, 4)), left[r * 4] * right[c]) for r in range(4) for c in range(4)]
    return F.array(*cells)


def inverse_matches(matrix: Column, inverse: Column, tolerance: Column | float = 1e-6) -> Column:
    """Whether both products of two matrices are the identity within ``tolerance``; false for malformed matrices."""
    unit = F.array(*[F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)])
    finite = lambda m: F.coalesce((F.size(m) == 16) & F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    near = lambda p: F.forall(F.zip_with(p, unit, lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    return F.when(finite(matrix) & finite(inverse), near(matrix_product(matrix, inverse)) & near(matrix_product(inverse, matrix))).otherwise(False)


def affine(matrix: Column, x: Column, y: Column, z: Column) -> Column:
    """A point under a 4x4 matrix, as array of three."""
    return F.array(*[matrix[r * 4] * x + matrix[r * 4 + 1] * y + matrix[r * 4 + 2] * z + matrix[r * 4 + 3] for r in range(3)])


def map_conversion(scale: Column, eastings: Column, northings: Column, height: Column, cos: Column, sin: Column) -> Column:
    """Matrix of a map conversion: rotation about the vertical, one scale, and an offset."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(scale * cos, -scale * sin, zero, eastings, scale * sin, scale * cos, zero, northings, zero, zero, scale, height, zero, zero, zero, one)


def projected(view: Column, x: Column, y: Column, z: Column) -> Column:
    """Point of a view: top drops z, front drops y, side drops x."""
    return F.when(view == "top", F.array(x, y)).when(view == "front", F.array(x, z)).when(view == "side", F.array(y, z))


def rotated_box(box: Column, degrees: Column, width: Column, height: Column) -> Column:
    """A box [left, top, right, bottom] of a page turned clockwise by a multiple of 90 degrees."""
    left, top, right, bottom = (box[k] for k in range(4))
    return (
        F.when(degrees == 0, box)
        .when(degrees == 90, F.array(height - bottom, left, height - top, right))
        .when(degrees == 180, F.array(width - right, height - bottom, width - left, height - top))
        .when(degrees == 270, F.array(top, width - right, bottom, width - left))
    )


def fan(count: Column) -> Column:
    """Triangles (0, k, k+1) of a polygon of ``count`` corners; none below three."""
    return F.when(count >= 3, F.transform(F.sequence(F.lit(1), count - 2), lambda k: F.array(F.lit(0), k, k + 1))).otherwise(F.array().cast("array<array<int>>"))


def safe_path(path: Column) -> Column:
    """Whether a logical path is relative and plain: no backslash, NUL, drive, empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.contains("\0") & ~path.contains(":") & ~path.startswith("/") & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))
