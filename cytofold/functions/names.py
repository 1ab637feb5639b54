"""Column functions for names, ids and labels of cells, channels and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of "nothing" in text columns.
NULL_SPELLINGS = ("", "None", "nan", "NaN", "<NA>")
# Prefixes and names that decide a feature's channel bucket.
MARKER_PREFIXES = ("cp1_", "cp2_")
PHASE_PREFIXES = ("phase2d", "focus3d")
PHASE_NAMES = ("nucleoli_phase2d", "nucleoli_focus3d")
FARRED_NAMES = ("cy5", "farred", "far_red", "far-red")
# What makes an organelle a network, or keeps it from being one.
NOT_NETWORK_CELLS = ("cell_mask", "cell_seg", "cp_cell")
NOT_NETWORK_NUCLEAR = ("nuclear", "nuclei", "nucleoli")
NETWORK_CHANNELS = ("gfp", "mcherry", "cy5")
# Labels that every run needs; parts of channel names that keep them from segmentation, with the reason.
CORE_LABELS = ("cell_mask", "nuclei", "cp_cell_mask")
SKIP_PATTERNS = (("prediction", "predicted, not stained; its labels come with the source channel"),)
# Detection methods other than the usual one, by structure and channel type.
METHODS = {
    ("vesicular", "labelfree"): "blob",
    ("vesicular", "fluorescent"): "blob",
    ("vesicular_dark", "labelfree"): "blob",
    ("vesicular_dark", "fluorescent"): "blob",
    ("vesicular", "focus3d"): "blob",
    ("vesicular_dark", "focus3d"): "blob",
}


def clean_str(c: Column) -> Column:
    """Null for every spelling of nothing."""
    return F.when(F.trim(c).isin(*NULL_SPELLINGS), None).otherwise(c)


def is_valid_label(c: Column) -> Column:
    """Not null, not empty, not "None"."""
    return F.coalesce(~c.isin("", "None"), F.lit(False))


def cell_id(well: Column, segmentation: Column, other: Column) -> Column:
    """well_segmentation; without it well_cp<other>; without both the empty string."""
    text = lambda c: c.cast("string")
    return (
        F.when(segmentation.isNotNull(), F.concat_ws("_", text(well), text(segmentation)))
        .when(other.isNotNull(), F.concat(text(well), F.lit("_cp"), text(other)))
        .otherwise(F.lit(""))
    )


def control_by_id(gene: Column, ncbi_id: Column, label: str = "NTC") -> Column:
    """Id -1 marks a control."""
    return F.when(ncbi_id == -1, label).otherwise(gene)


def control_by_name(gene: Column, label: str = "NTC") -> Column:
    """A missing gene or one spelled like the label in any case is a control."""
    return F.when(gene.isNull() | (F.upper(gene) == label), label).otherwise(gene)


def _any(name: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | name.contains(w)
    return out


def is_network(name: Column) -> Column:
    """May this organelle form a network? Rules in order: cell outlines and
    nuclear labels never, vesicular ones not, tubular ones, names that hold a
    fluorescent channel and stained markers do."""
    low = F.lower(name)
    return F.coalesce(
        F.when(_any(low, NOT_NETWORK_CELLS) | _any(low, NOT_NETWORK_NUCLEAR), False)
        .when(low.contains("vesicular"), False)
        .when(low.contains("tubular") | _any(low, NETWORK_CHANNELS), True)
        .when(_starts(low, (*MARKER_PREFIXES, "4i_")), True)
        .otherwise(False),
        F.lit(False),
    )


def _starts(name: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def channel_bucket(organelle: Column) -> Column:
    """Channel whose cells keep a feature of this organelle; ``agnostic`` is kept by all."""
    low = F.lower(F.coalesce(organelle, F.lit("")))
    return (
        F.when(_starts(low, ("4i_", *MARKER_PREFIXES)), low)
        .when(_starts(low, PHASE_PREFIXES) | low.isin(*PHASE_NAMES), "phase")
        .when(low.isin("gfp", "mcherry"), low)
        .when(low.isin("cy5", "farred"), "cy5")
        .otherwise("agnostic")
    )


def physical_channel(name: Column) -> Column:
    """Canonical physical channel; null if it is none."""
    low = F.lower(F.trim(name))
    return (
        F.when(low == "bf", "phase")
        .when(low.isin("gfp", "mcherry"), low)
        .when(low.isin(*FARRED_NAMES), "cy5")
        .when(_starts(low, (*MARKER_PREFIXES, "4i_")), low)
    )


def shown_channel(name: Column, aliases: tuple[tuple[str, str], ...] = ()) -> Column:
    """Canonical form of a shown channel: no trailing parenthesis, "Foo_Foo" is
    "foo", lower case, then long spellings replaced in the order given."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    raw = F.when(F.instr(raw, "(") > 1, F.trim(F.substring_index(raw, "(", 1))).otherwise(raw)
    parts = F.split(raw, "_")
    first, second = F.get(parts, 0), F.get(parts, 1)
    twice = (F.size(parts) == 2) & (first != "") & (F.lower(first) == F.lower(second))
    out = F.trim(F.lower(F.when(twice, first).otherwise(raw)))
    for long, short in aliases:
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def file_token(channel: Column) -> Column:
    """What follows the first underscore (all, if there is none), spaces as underscores."""
    rest = F.substr(channel, F.instr(channel, "_") + 1, F.length(channel))
    return F.replace(rest, F.lit(" "), F.lit("_"))


def safe_name(channel: Column) -> Column:
    """Lower-case name for files: spaces, slashes, commas and parentheses become
    single underscores, none at the ends."""
    out = F.regexp_replace(F.lower(F.trim(channel)), r"[ /,()]", "_")
    return F.regexp_replace(F.regexp_replace(out, "_{2,}", "_"), "^_+|_+$", "")


def bare_well(well: Column) -> Column:
    """The well without what follows the first underscore."""
    return F.substring_index(well, "_", 1)


def canonical_well(well: Column) -> Column:
    """A1, A/1 and A/1/0 are A/1/0."""
    split = F.regexp_replace(well, r"^([A-Za-z]+)(\d+)", "$1/$2")
    slashes = F.length(split) - F.length(F.replace(split, F.lit("/"), F.lit("")))
    return F.when(slashes >= 2, split).otherwise(F.concat(split, F.lit("/0")))


def is_excluded_pair(shown: Column, physical: Column) -> Column:
    """Alignment and empty channels: physical ``*_nuclei``, shown "no label"."""
    return F.coalesce(F.lower(physical).endswith("_nuclei"), F.lit(False)) | F.coalesce(F.lower(shown).contains("no label"), F.lit(False))


def exclusion_reason(shown: Column, physical: Column) -> Column:
    """Why a channel pair is left out; null if it is kept."""
    low = F.lower(shown)
    unlabelled = F.when(low.contains("autofluor"), "autofluorescence").when(low.contains("bleed"), "bleedthrough").when(low.contains("empty"), "empty well").otherwise("no label")
    return F.when(F.lower(physical) == "phase", None).when(F.lower(physical).endswith("_nuclei"), "DAPI registration").when(low.contains("no label"), unlabelled)


def skip_reason(channel: Column, patterns: tuple[tuple[str, str], ...] = SKIP_PATTERNS) -> Column:
    """Why a channel is not segmented: the reason of the first pattern in its name; null if it is."""
    out = F.lit(None).cast("string")
    for pattern, reason in reversed(patterns):
        out = F.when(F.lower(channel).contains(pattern), reason).otherwise(out)
    return out


def label_wanted(label: Column, modality: str = "all", explicit: tuple[str, ...] = ()) -> Column:
    """Is this stored label an input of a run? Core labels always are; otherwise the
    explicit list decides if there is one, else the modality ("all", "phase", "fluorescent")."""
    core = label.isin(*CORE_LABELS)
    if explicit:
        return core | label.isin(*explicit)
    own = F.lower(label).startswith("cp")
    rules = {"all": F.lit(True), "phase": core | ~own, "fluorescent": core | own}
    if modality not in rules:
        raise ValueError(f"unknown modality {modality!r}")
    return rules[modality]


def centre_crop(height: Column, width: Column, fraction: float, least: int = 512) -> Column:
    """(y0, y1, x0, x1) of a centred crop that keeps ``fraction`` of the area,
    ``least`` pixels a side at least, within the image."""

    def span(size: Column) -> tuple[Column, Column]:
        side = F.greatest(F.floor(size * F.sqrt(F.lit(float(fraction)))), F.lit(least)).cast("int")
        begin = F.floor(size / 2).cast("int") - F.floor(side / 2).cast("int")
        return F.greatest(F.lit(0), begin), F.least(size, begin + side)

    (y0, y1), (x0, x1) = span(height), span(width)
    return F.struct(y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))


def resolved_method(runtime: Column, configured: Column, structure: Column, channel: Column) -> Column:
    """Detection method: a caller's, else the configured one, else that of the
    fixed table for the structure and channel type; null means not set."""
    table = F.lit("frangi")
    for (kind, source), method in reversed(METHODS.items()):
        table = F.when((structure == kind) & (channel == source), method).otherwise(table)
    return F.coalesce(runtime, configured, table)


def sigma_grid(low_um: Column, high_um: Column, pixel_um: float, n: int = 5) -> Column:
    """Geometric grid of n scales in pixels between two radii in microns."""
    low, high = low_um / pixel_um, high_um / pixel_um
    step = lambda i: low * F.pow(high / low, i / F.lit(float(max(n - 1, 1))))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), step)


def chunk_key(y: Column, x: Column, size: int = 512, missing: int = 999_999) -> Column:
    """Chunk of a coordinate pair; missing coordinates share one far chunk."""
    one = lambda c: F.floor(F.coalesce(c, F.lit(missing)) / size)
    return F.struct(one(y).alias("cy"), one(x).alias("cx"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all float columns become null: Spark's aggregates skip null only."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({n: F.when(~bad(F.col(f"`{n}`")), F.col(f"`{n}`")) for n, t in df.dtypes if t in ("float", "double")})


def parse_bbox(text: Column) -> Column:
    """(y0, x0, y1, x1) as a struct from text such as "(1, 2, 3, 4)" or "[1 2 3 4]"; null if it has not four numbers."""
    numbers = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    names = ("y0", "x0", "y1", "x1")
    return F.when(F.size(numbers) == 4, F.struct(*(F.get(numbers, k).cast("double").cast("int").alias(n) for k, n in enumerate(names))))


def label_name(organelle: Column, method: Column | None = None, length: int | None = None) -> Column:
    """Stored name of a label: lower case, spaces as underscores, ``_seg`` at the
    end; the legacy form cuts the organelle to ``length`` characters."""
    low = F.replace(F.lower(F.trim(organelle)), F.lit(" "), F.lit("_"))
    low = low if length is None else F.substr(low, F.lit(1), F.lit(length))
    return F.concat_ws("_", low, *([] if method is None else [F.lower(method)]), F.lit("seg"))


#: Labels that name no marker, and endings of labels that name a dye or light.
NO_MARKER = ("", "phase", "no label", "empty", "empty, no label")
MARKER_ENDINGS = (" live cell dye", " live-cell dye", " live cell", " excitation")


def marker_of(label: Column) -> Column:
    """The marker in a free-text label: what follows the last comma, or what stands
    before it if that says "no label"; without an ending that names a dye or light,
    white space as underscores, up to the first character that is no letter, digit,
    underscore or hyphen. Null if the label names none."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text = bare(label)
    tail, head = bare(F.regexp_extract(text, r"(?s)([^,]*)$", 1)), bare(F.regexp_replace(text, r"(?s),[^,]*$", ""))
    name = F.when(F.lower(tail).isin("no label", ""), head).otherwise(tail)
    name = F.regexp_replace(name, "(?i)^bleedthough$", "bleedthrough")
    for end in MARKER_ENDINGS:
        name = F.regexp_replace(name, rf"(?i)\s*{end}$", "")
    word = F.regexp_extract(F.regexp_replace(name, r"\s+", "_"), r"^[A-Za-z0-9_\-]+", 0)
    return F.when(~F.lower(text).isin(*NO_MARKER), F.nullif(F.btrim(word, F.lit("_-")), F.lit("")))


def best_source(files: DataFrame, token: str, folder: str, priority: tuple[str, ...], aliases: dict[str, str] | None = None) -> DataFrame:
    """One path for each token (any case, aliases resolved) from the first folder in ``priority`` that has it."""
    name = F.col(token)
    for long, short in (aliases or {}).items():
        name = F.when(F.col(token) == long, F.lit(short)).otherwise(name)
    rank = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col(folder))
    known = files.withColumns({"_token": F.lower(name), "_rank": rank}).where("_rank > 0")
    return known.groupBy("_token").agg(F.min_by("path", F.struct("_rank", "path")).alias("path")).withColumnRenamed("_token", token)


def bridge_custom(cells: DataFrame, gene: str, control_type: str = "neg_ctrl") -> DataFrame:
    """Custom perturbation tables: barcode stands in for a missing sgRNA, ``gene``
    for a missing gene name, and control rows take their type as gene name."""
    names = set(cells.columns)
    out = cells
    if "barcode" in names:
        out = out.withColumn("sgRNA", F.coalesce("sgRNA", "barcode") if "sgRNA" in names else F.col("barcode"))
    if gene in names:
        out = out.withColumn("gene_name", F.coalesce("gene_name", gene) if "gene_name" in names else F.col(gene))
    if "row_type" in names:
        out = out.withColumn("gene_name", F.when(F.col("row_type") == control_type, control_type).otherwise(F.col("gene_name")))
    return out
