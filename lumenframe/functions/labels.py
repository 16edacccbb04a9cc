"""Text functions for tags, captions, labels and relation phrases (SC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that name nothing.
GENERIC_TAGS = ("object", "objects", "thing", "things", "item", "items", "entity", "entities", "scene", "image", "photo", "picture")

#: Words that are no label of a caption.
STOPWORDS = (
    "a", "an", "the", "some", "one", "two", "three",
    "with", "on", "of", "in", "at", "by", "and", "or", "from", "to", "for", "as", "up", "out", "into", "over", "under", "about", "around",
    "is", "are", "was", "were", "be", "been", "being", "has", "have", "can", "may", "will", "appears", "seems", "showing", "shows", "shown",
    "this", "that", "these", "those", "it", "its", "there", "their",
    "image", "photo", "picture", "view", "close", "shot",
    "side", "top", "front", "back", "left", "right", "center", "middle",
    "red", "blue", "green", "yellow", "white", "black", "brown", "grey", "gray", "orange", "purple", "pink", "dark", "light", "bright",
    "large", "small", "big", "little", "tiny", "tall", "short", "long", "old", "new", "open", "closed", "empty", "full", "flat", "round",
    "square", "wooden", "metal", "plastic", "glass", "stone", "brick", "single", "double", "multiple", "various", "different", "same",
    "very", "quite", "just", "also", "well",
)

#: Phrases and predicates, in order of precedence.
RELATION_RULES = (
    (("on top of", "resting on", "placed on", "sitting on", "standing on", "lying on"), "on"),
    (("under", "below", "beneath"), "under"),
    (("next to", "beside", "adjacent", "alongside"), "is_next_to"),
    (("in front of", "in front"), "in_front_of"),
    (("behind", "in back of"), "behind"),
    (("inside", "within", "contained in", "in the"), "inside_of"),
    (("hanging from", "suspended from"), "hangs_from"),
    (("leaning on", "leaning against"), "leans_on"),
    (("at", "located at"), "at"),
    (("holding", "carrying", "gripping", "grabbing"), "holds"),
    (("wearing", "dressed in"), "wears"),
    (("riding", "mounted on"), "rides"),
    (("eating", "consuming"), "eats"),
    (("drinking",), "drinks"),
    (("reading",), "reads"),
    (("using", "operating"), "uses"),
    (("looking at", "gazing at"), "looks_at"),
    (("talking on", "speaking on"), "talks_on_phone"),
    (("playing",), "plays"),
    (("kicking",), "kicks"),
    (("catching",), "catches"),
    (("cutting",), "cuts"),
)


def parse_tags(text: Column, max_tags: int = 8) -> Column:
    """SC-01, ST-06, TK-03: distinct specific tags in order of first appearance."""
    parts = F.split(F.lower(F.trim(text)), r"[|,;.]")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    specific = F.filter(clean, lambda p: (p != "") & ~p.isin(*GENERIC_TAGS))
    return F.slice(F.array_distinct(specific), 1, max_tags)


def _python_text(value: Column) -> Column:
    """A variant as Python writes it: strings in a list are quoted."""
    kind = F.schema_of_variant(value)
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit("'"), F.try_variant_get(v, "$", "string"), F.lit("'"))).otherwise(F.to_json(v)),
    )
    plain = F.try_variant_get(value, "$", "string")
    return F.when(kind.startswith("ARRAY"), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))).when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)


def tag_field(payload: Column) -> Column:
    """SC-02: of a JSON object, the text of the first non-empty field that taggers use; of
    a list, its first element; of anything else, its text.  Null and empty give ""."""
    whole = F.try_parse_json(payload)
    kind = F.schema_of_variant(whole)
    fields = []
    for name in ("tags", "tag_en", "english", "labels"):
        v = F.try_variant_get(whole, f"$.{name}", "variant")
        text = _python_text(v)
        fields.append(F.when(~F.is_variant_null(v) & ~text.isin("", "[]", "0", "False"), text))
    first = F.try_variant_get(whole, "$[0]", "variant")
    of_list = F.when(~F.is_variant_null(first), _python_text(first))
    return F.coalesce(F.when(kind.startswith("OBJECT"), F.coalesce(*fields)).when(kind.startswith("ARRAY"), of_list).when(~F.is_variant_null(whole), _python_text(whole)), F.lit(""))


def caption_noun(caption: Column) -> Column:
    """SC-03: the first alphabetic word of three letters or more that is no stopword."""
    words = F.transform(F.split(F.lower(caption), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()]+|[.,;:!?"'()]+$""", ""))
    nouns = F.filter(words, lambda w: w.rlike(r"^\p{L}{3,}$") & ~w.isin(*STOPWORDS))
    return F.coalesce(F.get(nouns, F.lit(0)), F.lit("object"))


def relation_phrase(caption: Column, word_boundary: bool = False) -> Column:
    """SC-04: the predicate of the first rule of which a phrase occurs, else null.

    Phrases match inside words ("plate" holds "at") unless word_boundary is set."""
    out = None
    for phrases, predicate in RELATION_RULES:
        if word_boundary:
            hit = caption.rlike(r"\b(?:" + "|".join(phrases) + r")\b")
        else:
            hit = F.lit(False)
            for p in phrases:
                hit = hit | caption.contains(p)
        out = F.when(hit, predicate) if out is None else out.when(hit, predicate)
    return out


def clean_label(label: Column) -> Column:
    """SC-05: trimmed, lower-cased; empty or null is `object`."""
    return F.coalesce(F.nullif(F.lower(F.trim(label)), F.lit("")), F.lit("object"))


def choose_label(detector: Column, detector_conf: Column, caption_label: Column, caption: Column, tag: Column, tag_conf: Column) -> Column:
    """SC-06: detector, then caption, then tag, then the generic label; with what each
    labeller says.  The tagger is asked only where the others know nothing specific."""
    d, c, t = clean_label(detector), clean_label(caption_label), clean_label(tag)
    asked = (d == "object") & (c == "object")
    tagged = F.when(asked, t).otherwise("object")
    own = F.when(asked & (t != "object"), F.array(t)).otherwise(F.array().cast("array<string>"))

    def made(label: Column, conf: Column, text: Column, source: str) -> Column:
        return F.struct(
            label.alias("label"), conf.cast("double").alias("conf"), text.alias("caption"), F.lit(source).alias("source_model"),
            c.alias("florence2_label"), caption.alias("florence2_caption"), tagged.alias("rampp_label"), tagged.alias("rampp_caption"), own.alias("rampp_tags"),
        )

    return (
        F.when(d != "object", made(d, detector_conf, d, "detector"))
        .when(c != "object", made(c, F.lit(0.75), caption, "caption"))
        .when(t != "object", made(t, tag_conf, t, "tags"))
        .otherwise(made(F.lit("object"), F.lit(0.0), F.coalesce(F.nullif(caption, F.lit("")), F.lit("object")), "fallback"))
    )


def candidate_confidence(kind: Column, given: Column) -> Column:
    """SC-07: confidence of a label by where it comes from."""
    return F.when(kind == "caption", 0.75).when(kind == "box", 0.80).when(kind == "tag", F.coalesce(given, F.lit(0.70))).otherwise(0.0)


def query_text(tags: Column, default: str) -> Column:
    """SC-08: tags joined into one detector query."""
    return F.when(F.size(tags) > 0, F.concat(F.array_join(tags, ". "), F.lit("."))).otherwise(default)


def object_id(idx: Column, segmentor: Column | None = None) -> Column:
    """SC-12: all segmentors of the first track share a template, the second has its own."""
    first = F.concat(F.lit("obj_"), idx.cast("string"), F.lit("_GroundedSAM2"))
    return first if segmentor is None else F.when(segmentor == "SAM3", F.concat(F.lit("sam3_obj_"), idx.cast("string"))).otherwise(first)


def external_id(label: Column) -> Column:
    return F.concat(F.lit("external_"), F.coalesce(F.nullif(F.lower(F.trim(label)), F.lit("")), F.lit("unknown")))


def external_label(target_id: Column) -> Column:
    return F.regexp_replace(target_id, "external_", "")


def ratio_text(num: Column, den: Column) -> Column:
    """SC-13: percent with one decimal, or n/a."""
    return F.when(den == 0, "n/a").otherwise(F.format_string("%.1f%%", 100.0 * num / den))
