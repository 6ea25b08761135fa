"""Column expressions: identifiers, feature names, control predicates and guarded arithmetic.

Everything here is a built-in expression, so it stays inside generated code and can be pushed
to the scan where Spark supports it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: names of the aggregates, categories, units and patterns --------------------
AGGREGATES = ["mean", "median", "std", "sum", "min", "max", "count"]

METRIC_UNITS = {
    "area": "um^2",
    "area_convex": "um^2",
    "area_filled": "um^2",
    "perimeter": "um",
    "perimeter_crofton": "um",
    "axis_major_length": "um",
    "axis_minor_length": "um",
    "equivalent_diameter_area": "um",
    "centroid_y": "um",
    "centroid_x": "um",
    "centroid_weighted_y": "um",
    "centroid_weighted_x": "um",
    "distance_from_cell_edge": "um",
    "distance_from_nucleus": "um",
    "distance_from_nucleus_centroid": "um",
    "branch_length": "um",
    "branch_thickness": "um",
    "total_branch_length": "um",
    "solidity": "ratio",
    "extent": "ratio",
    "eccentricity": "ratio",
    "aspect_ratio": "ratio",
    "circularity": "ratio",
    "area_fraction": "ratio",
    "intensity_cv": "ratio",
    "moments_weighted_hu_0": "ratio",
    "moments_weighted_hu_1": "ratio",
    "moments_weighted_hu_2": "ratio",
    "moments_weighted_hu_3": "ratio",
    "moments_weighted_hu_4": "ratio",
    "moments_weighted_hu_5": "ratio",
    "moments_weighted_hu_6": "ratio",
    "inertia_eigval_0": "ratio",
    "inertia_eigval_1": "ratio",
    "normalized_radial_position": "ratio",
    "tortuosity": "ratio",
    "average_degree": "ratio",
    "orientation": "radians",
    "euler_number": "count",
    "count": "count",
    "num_branches": "count",
    "num_nodes": "count",
    "num_endpoints": "count",
    "branch_count": "count",
    "skeleton_pixel_count": "count",
    "num_skeleton_components": "count",
    "intensity_mean": "AU",
    "intensity_max": "AU",
    "intensity_min": "AU",
    "intensity_std": "AU",
    "intensity_median": "AU",
    "intensity_q25": "AU",
    "intensity_q75": "AU",
    "intensity_iqr": "AU",
    "intensity_mad": "AU",
    "intensity_integrated": "AU",
    "intensity_range": "AU",
    "branching_density": "1/um^2",
    "network_length_density": "um/um^2",
}

METADATA_PATTERNS = [
    "_id", "cell_id", "gene_name", "gene_symbol", "barcode", "sgRNA", "guide_",
    "perturbation", "_effect", "NCBI", "_index", "well_", "_well", "pos_", "y_global_pheno",
    "x_global_pheno", "y_local_pheno", "x_local_pheno", "tile_pheno", "area_pheno",
    "cp1_pheno_distance", "y_global_bc", "x_global_bc", "Unnamed", "bbox", "umap_",
    "cluster_", "radial_", "label",
]

CONTROL_PATTERN = "(?i)ntc|non-targeting|^0$"
CONTROL_PATTERN_LEGACY = "(?i)ntc|non-targeting"
# ----------------------------------------------------------------------------------------------


def finite(c: Column) -> Column:
    """NaN and infinities become null, so aggregates skip them."""
    d = c.cast("double")
    bad = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(~bad, d)


def safe_number(c: Column | str) -> Column:
    """Text to double; anything unreadable becomes null instead of failing the job."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


# --- controls and guides ----------------------------------------------------------------------
def is_control(
    gene: Column, gene_id: Column | None = None, ncbi_id: Column | None = None,
    barcode: Column | None = None,
) -> Column:
    """Control rows: id -1, a missing gene, or a gene name that matches the control pattern.

    With ``barcode`` the row is also a control when the barcode starts with NTC.
    """
    hit = gene.isNull() | F.trim(gene).isin("", "None") | gene.rlike(CONTROL_PATTERN)
    for ident in (gene_id, ncbi_id):
        if ident is not None:
            hit = hit | F.coalesce(ident == -1, F.lit(False))
    if barcode is not None:
        hit = hit | F.coalesce(F.upper(barcode).startswith("NTC"), F.lit(False))
    return hit


def is_control_by_name(gene: Column, legacy: bool = False) -> Column:
    """Pattern-only control predicate; the legacy form does not treat gene '0' as control."""
    pattern = CONTROL_PATTERN_LEGACY if legacy else CONTROL_PATTERN
    return F.coalesce(gene.rlike(pattern), F.lit(False))


def relabel_control(gene: Column, ncbi_id: Column | None = None) -> Column:
    named = F.when(gene == "0", F.lit("NTC"))
    if ncbi_id is not None:
        named = F.when(F.coalesce(ncbi_id == -1, F.lit(False)), F.lit("NTC")).when(gene == "0", "NTC")
    return named.otherwise(gene)


def has_guide(guide: Column) -> Column:
    return F.coalesce(~guide.isin("", "None"), F.lit(False))


def gene_group(control: Column) -> Column:
    return F.when(control, F.lit("NTC")).otherwise(F.lit("Perturbed"))


def global_id(well: Column, seg: Column, cp_seg: Column) -> Column:
    """`well_seg`, or `well_cp<id>` where only the fixed-stain segment exists."""
    return F.when(seg.isNotNull(), F.concat_ws("_", well, seg.cast("string"))).when(
        cp_seg.isNotNull(), F.concat(well, F.lit("_cp"), cp_seg.cast("string"))
    )


# --- feature names ----------------------------------------------------------------------------
def metric_unit(metric: Column) -> Column:
    """Unit by one lookup in a literal map; unlisted metrics are ``unknown``."""
    pairs = [F.lit(x) for item in METRIC_UNITS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), metric), F.lit("unknown"))


def _escape(name: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in name)


def parse_feature(name: Column, organelles: Sequence[str]) -> Column:
    """Struct(organelle, metric, category, aggregation) read from a feature column name.

    One alternation ordered by length gives the longest organelle prefix, so the cost per name
    does not grow with a loop over organelles.
    """
    alternatives = "|".join(_escape(o) for o in sorted(organelles, key=lambda o: (-len(o), o)))
    aggs = "|".join(AGGREGATES)
    found = lambda text, regex: F.nullif(F.regexp_extract(text, regex, 1), F.lit(""))

    def split(n: Column) -> Column:
        bare = F.regexp_replace(n, "^network_", "")
        rest = F.regexp_replace(bare, f"_({aggs})$", "")
        return F.struct(
            n.alias("name"), n.startswith("network_").alias("net"), found(bare, f"_({aggs})$").alias("agg"), rest.alias("rest"),
            found(rest, f"^({alternatives})(_|$)").alias("org"), found(n, "^(cp_cell|cell)_").alias("cell"),
        )

    def measured(s: Column) -> Column:
        whole = F.coalesce(s["rest"] == s["org"], F.lit(False))
        after = F.when(s["org"].isNull(), s["rest"]).when(whole, F.lit("")).otherwise(F.substr(s["rest"], F.length(s["org"]) + 2))
        counted = whole & ~s["net"]
        metric = F.when(s["cell"].isNotNull(), F.substr(s["name"], F.length(s["cell"]) + 2)).when(
            counted, F.when(s["agg"] == "count", F.lit("count")).otherwise(F.lit(""))).otherwise(after)
        agg = F.when(s["cell"].isNull() & ~counted, s["agg"])
        return F.struct(s.alias("s"), metric.alias("metric"), agg.alias("agg"))

    def described(t: Column) -> Column:
        s, metric = t["s"], t["metric"]
        kind = (
            F.when(s["cell"].isNotNull(), "cell_morphology").when(s["net"], "network")
            .when(s["org"].isNull() | (metric == ""), "unknown").when(metric.contains("intensity"), "intensity")
            .when(metric.contains("distance_from") | metric.contains("normalized_radial"), "localization").otherwise("morphology")
        )
        return F.struct(
            F.coalesce(s["cell"], s["org"]).alias("organelle"), metric.alias("metric"), kind.alias("category"), t["agg"].alias("aggregation")
        )

    # each step binds the one before it, so no expression is repeated in the plan
    steps = F.transform(F.transform(F.transform(F.array(name), split), measured), described)
    return F.get(steps, F.lit(0))


def reporter_type(label: Column) -> Column:
    return F.trim(F.split(label, ",", 2)[0])


def reporter_of_component(name: Column) -> Column:
    """`mito_PC12` -> `mito`; null where the name is not a component column."""
    return F.nullif(F.regexp_extract(name, r"^(.+)_PC\d+$", 1), F.lit(""))


def short_experiment(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def fuzzy_key(name: Column) -> Column:
    return F.lower(F.translate(name, "_-", "  "))


def collapsed_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[_\- ]", ""))


def label_code(organelle: Column, marker: Column, kind: Column) -> Column:
    """`{first five}_{first six}_{kind}_seg` in lower case."""
    return F.lower(F.concat_ws("_", F.substring(organelle, 1, 5), F.substring(marker, 1, 6), kind, F.lit("seg")))


def strip_aggregates(name: Column, recursive: bool = False) -> Column:
    aggs = "|".join(AGGREGATES)
    return F.regexp_replace(name, f"(_({aggs}))+$" if recursive else f"_({aggs})$", "")


def is_network_organelle(name: Column) -> Column:
    """Tubular, tagged or fixed-stain structures, unless nuclear, vesicular or a cell outline."""
    low = F.lower(name)
    excluded = low.rlike("cell_mask|cell_seg|cp_cell|nuclear|nuclei|nucleoli|vesicular")
    return ~excluded & low.rlike("tubular|gfp|mcherry|cy5|^cp1_|^cp2_")


# --- bounding boxes ---------------------------------------------------------------------------
def parse_bbox(text: Column) -> Column:
    """`[1 2 3 4]`, `(1, 2, 3, 4)` -> array<int> of four, null for anything else."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[\[\]\(\),\s]+", " ")), " ")
    numbers = F.transform(parts, lambda p: p.try_cast("double").try_cast("int"))
    ok = (F.size(numbers) == 4) & F.forall(numbers, lambda n: n.isNotNull())
    return F.when(ok, numbers)


def bbox_area(box: Column) -> Column:
    return F.when(box.isNotNull(), (box[2] - box[0]) * (box[3] - box[1]))


# --- arithmetic -------------------------------------------------------------------------------
def log2_ratio(a: Column, b: Column, eps: float = 1e-10) -> Column:
    ratio = F.try_divide(a + F.lit(eps), b + F.lit(eps))
    return F.when(ratio > 0, F.log2(ratio))


def log2_ratio_floor(a: Column, b: Column, floor: float = 1e-9) -> Column:
    """Zero denominators become ``floor``; ratios that are not positive have no logarithm."""
    ratio = a / F.when(b == 0, F.lit(floor)).otherwise(b)
    return F.when(ratio > 0, F.log2(ratio))


def neg_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def ellipse_perimeter(major: Column, minor: Column) -> Column:
    """Ramanujan's first approximation from full axis lengths; a zero minor axis counts as 0.1."""
    a = major / 2
    b = F.when(minor == 0, F.lit(0.1)).otherwise(minor) / 2
    return F.lit(math.pi) * (3 * (a + b) - F.sqrt((3 * a + b) * (a + 3 * b)))


def circularity(area: Column, perimeter: Column) -> Column:
    safe = F.when(perimeter == 0, F.lit(1.0)).otherwise(perimeter)
    return F.lit(4 * math.pi) * area / (safe * safe)


def aspect_ratio(major: Column, minor: Column) -> Column:
    return major / F.when(minor == 0, F.lit(1.0)).otherwise(minor)


def micron_to_pixels(um: Column, pixel_size: Column) -> Column:
    return F.try_divide(um, pixel_size)


def blob_sigma(diameter_um: Column, pixel_size: Column) -> Column:
    """Gaussian sigma in pixels whose blob has the given diameter: r / sqrt(2)."""
    return F.try_divide(diameter_um / 2, pixel_size) / F.lit(math.sqrt(2.0))


def harmonic(x: Column) -> Column:
    """H(x) for integer x >= 0 from its asymptotic series shifted by ten, good to 1e-14."""
    y = x.cast("double") + 10.0
    q = 1 / (y * y)
    tail = F.lit(1 / 12) - q * (F.lit(1 / 120) - q * (F.lit(1 / 252) - q * (F.lit(1 / 240) - q * F.lit(1 / 132))))
    series = F.log(y) + 0.5772156649015329 + 1 / (2 * y) - q * tail
    for j in range(1, 11):
        series = series - 1 / (x.cast("double") + float(j))
    return series


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


# --- vectors ----------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v))
