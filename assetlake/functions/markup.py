"""Measures and rewrites of markup text. Whole texts, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .columns import mime_of_format


def without_comments(text: Column) -> Column:
    """Markup without comments and CDATA sections, which hold no elements."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")


def node_count(text: Column) -> Column:
    """Elements; use on text `without_comments`, as the other measures."""
    return F.regexp_count(text, F.lit("<[a-zA-Z]"))


def segment_count(text: Column, attribute: str = "d") -> Column:
    """Path command letters (any letter but e/E) over all values of the path attribute."""
    quoted = F.regexp_extract_all(
        text, F.lit(rf"\s{attribute}\s*=\s*(\"[^\"]*\"|'[^']*')"), F.lit(1)
    )
    return F.regexp_count(F.array_join(quoted, " "), F.lit("[a-df-zA-DF-Z]"))


def raster_bytes(text: Column, scheme: str = "data:") -> Column:
    """Total length of link values that start with the scheme."""
    quoted = F.regexp_extract_all(
        text,
        F.lit(rf"\s(?:xlink:)?href\s*=\s*(\"{scheme}[^\"]*\"|'{scheme}[^']*')"),
        F.lit(1),
    )
    return (F.length(F.array_join(quoted, "")) - 2 * F.size(quoted)).cast("bigint")


def has_filters(text: Column, names: str = "filter|mask|clipPath") -> Column:
    return F.coalesce(text.rlike(rf"<(?:{names})[\s/>]"), F.lit(False))


def svg_class(
    raster: Column,
    nodes: Column,
    segments: Column,
    nodes_max: int = K.SVG_NODES_MAX,
    segments_max: int = K.SVG_SEGMENTS_MAX,
) -> Column:
    return (
        F.when(raster > 0, F.lit("HYBRID"))
        .when((nodes > nodes_max) | (segments > segments_max), F.lit("COMPLEX"))
        .otherwise(F.lit("SIMPLE"))
    )


def representation_flags(
    size: Column,
    nodes: Column,
    segments: Column,
    raster: Column,
    *,
    tiny: int = K.SVG_TINY_BYTES,
    nodes_max: int = K.SVG_NODES_MAX,
    segments_max: int = K.SVG_SEGMENTS_MAX,
    raster_max: int = K.SVG_RASTER_BYTES_MAX,
    raster_hybrid: int = K.SVG_RASTER_BYTES_HYBRID,
    dominance: float = K.SVG_RASTER_DOMINANCE,
    nodes_anchor: int = K.SVG_NODES_ANCHOR,
) -> dict[str, Column]:
    """Why a vector document would be wrapped, and whether it is."""
    share = raster / F.greatest(F.lit(1), size).cast("double")
    flags = {
        "is_tiny": size < tiny,
        "vector_complex": (nodes > nodes_max) | (segments > segments_max),
        "heavy_hybrid": raster > raster_max,
        "hybrid_dominant": (raster > raster_hybrid) & (share > dominance),
        "complexity_anchor": (raster > 0) & (nodes > nodes_anchor),
    }
    reasons = (
        flags["vector_complex"]
        | flags["heavy_hybrid"]
        | flags["hybrid_dominant"]
        | flags["complexity_anchor"]
    )
    return {**flags, "wrap": ~flags["is_tiny"] & reasons}


def representation_label(wrap: Column, internal_format: str = "webp") -> Column:
    return F.when(wrap, F.lit(f"svg ({internal_format}-wrapped)")).otherwise(
        F.lit("svg (optimized)")
    )


def one_line_base64(payload: Column) -> Column:
    """Base64 without the line breaks some versions put after 76 characters."""
    return F.translate(F.base64(payload), "\r\n", "")


def wrap_markup(width: Column, height: Column, fmt: Column, payload: Column) -> Column:
    """Vector document that shows one embedded raster at its logical size."""
    w, h = width.cast("string"), height.cast("string")
    return F.concat(
        F.lit('<svg width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h,
        F.lit(f'" xmlns="{K.SVG_NAMESPACE}">\n  <image href="data:'), mime_of_format(fmt),
        F.lit(";base64,"), one_line_base64(payload), F.lit('" width="'), w, F.lit('" height="'), h,
        F.lit('" />\n</svg>'),
    )


EMBEDDED = r'href="data:image/(\w+);base64,([^"]+)"'


def embedded_type(text: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(text, EMBEDDED, 1), F.lit("")))


def embedded_bytes(text: Column) -> Column:
    return F.unbase64(F.nullif(F.regexp_extract(text, EMBEDDED, 2), F.lit("")))


def root_dimensions(text: Column, width: Column, height: Column, tag: str = "svg") -> Column:
    """Give the first root tag explicit dimensions; text without the tag is unchanged.

    Only the root tag is edited, and an attribute counts only after whitespace, so
    `stroke-width` and later elements stay as they are.
    """
    attribute = r"(?i)\s+(?:width|height)\s*=\s*(?:\"[^\"]*\"|'[^']*')"
    given = F.concat(
        F.lit('width="'), width.cast("string"), F.lit('" height="'), height.cast("string"),
        F.lit('" '),
    )

    def edit(doc: Column) -> Column:
        body, start = doc["body"], doc["start"]
        opening = F.regexp_extract(F.substr(body, start + len(tag) + 1), r"^[^>]*", 0)

        def rewrite(opened: Column) -> Column:
            space = F.regexp_extract(opened, r"^\s*", 0)
            kept = F.regexp_replace(F.concat(F.lit(" "), F.ltrim(opened)), attribute, "")
            return F.concat(
                F.substr(body, F.lit(1), start - 1), F.lit(f"<{tag}"),
                F.when(space == "", F.lit(" ")).otherwise(space),
                given, F.ltrim(kept), F.substr(body, start + len(tag) + 1 + F.length(opened)),
            )

        return F.when(start > 0, _let(opening, rewrite)).otherwise(text)

    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    located = F.struct(
        body.alias("body"), F.regexp_instr(body, F.lit(rf"(?i)<{tag}\b")).alias("start")
    )
    return _let(located, edit)


def _let(value: Column, use) -> Column:
    """Use a value several times but compute it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
