"""Generation metadata: workflow graphs (JSON) and parameter text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.text import strip

# A workflow maps node ids to nodes; inputs hold strings, numbers or [node, slot] references.
NODE_TYPE = "struct<class_type:string,inputs:map<string,string>>"
WORKFLOW_TYPE = f"map<string,{NODE_TYPE}>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def workflow(json_text) -> Column:
    """Parsed workflow; references and numbers stay as their JSON text."""
    return F.from_json(_col(json_text), WORKFLOW_TYPE)


def node_input_by_id(json_text, node: str, name: str) -> Column:
    return F.element_at(F.element_at(workflow(json_text), node)["inputs"], name)


def node_input_by_class(json_text, class_type: str, name: str) -> Column:
    """Input of the first node of a class."""
    nodes = F.filter(F.map_values(workflow(json_text)), lambda n: n["class_type"] == class_type)
    return F.element_at(F.get(nodes, F.lit(0))["inputs"], name)


def related_pointer(json_text, node: str = "LoadImage") -> Column:
    """Related path: a node's ``image`` input, else the top-level ``related_image`` text."""
    found = node_input_by_id(json_text, node, "image") if node.isdigit() else node_input_by_class(json_text, node, "image")
    return F.coalesce(found, F.get_json_object(_col(json_text), "$.related_image"))


def tags(json_text) -> Column:
    return F.from_json(_col(json_text), "array<string>")


def pretty(value) -> Column:
    """Readable JSON of a struct or map column."""
    return F.to_json(_col(value), {"pretty": "true"})


def parse_nested(values) -> Column:
    """Map of strings whose JSON objects are opened: value text → map, null when it is not JSON."""
    return F.transform_values(_col(values), lambda _, v: F.when(strip(v).startswith("{"), F.from_json(v, "map<string,string>")))


def _drop_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def workflow_models(df: DataFrame, ident: str, json_col: str) -> DataFrame:
    """(id, models, loras) of workflow graphs; LoRAs with zero strength on both sides do not count."""
    nodes = df.select(F.col(ident), F.posexplode(F.map_values(workflow(json_col))).alias("pos", "node"))
    kind, inputs = F.col("node.class_type"), F.col("node.inputs")

    def value(name: str) -> Column:
        return F.element_at(inputs, name)

    def strength(name: str) -> Column:
        return F.coalesce(value(name).cast("double"), F.lit(0.0))

    model = F.when(kind.contains("Checkpoint") & value("ckpt_name").isNotNull(), value("ckpt_name")).when(
        (kind == "UNETLoader") & value("unet_name").isNotNull(), value("unet_name")
    )
    lora = F.when(
        model.isNull() & kind.contains("Lora") & value("lora_name").isNotNull()
        & ((strength("strength_model") != 0) | (strength("strength_clip") != 0)),
        value("lora_name"),
    )
    marked = nodes.select(ident, "pos", _drop_ext(model).alias("model"), _drop_ext(lora).alias("lora"))

    def listed(name: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("pos", name))))
        return F.transform(pairs, lambda p: p[name])

    # a workflow has a bounded number of nodes, so these lists are small
    found = marked.groupBy(ident).agg(listed("model").alias("models"), listed("lora").alias("loras"))
    empty = F.array().cast("array<string>")
    return df.select(ident).join(found, ident, "left").select(
        ident, F.coalesce("models", empty).alias("models"), F.coalesce("loras", empty).alias("loras")
    )


def _reference(text: Column) -> Column:
    """Node id of a '["id",slot]' reference, null for plain text."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")[0])


def workflow_prompts(df: DataFrame, ident: str, json_col: str) -> DataFrame:
    """(id, positive, negative) of workflow graphs.

    The first node with positive and negative inputs names two conditioning nodes (a KSampler
    only when no such node came before); conditioning references are followed to a text encoder, in as
    many steps as the graph has nodes, so a chain ends and a cycle leads nowhere. The text of the last wildcard node
    replaces the positive one.
    """
    graph = workflow(json_col)
    entries = F.map_entries(graph)
    base = df.select(F.col(ident), graph.alias("g"), entries.alias("e"))
    chosen = F.get(
        F.filter(
            F.col("e"),
            lambda n: F.map_contains_key(n["value"]["inputs"], "positive") & F.map_contains_key(n["value"]["inputs"], "negative"),
        ),
        F.lit(0),
    )
    # a later node that is not a KSampler overrides the first choice
    later = F.filter(
        F.col("e"),
        lambda n: F.map_contains_key(n["value"]["inputs"], "positive")
        & F.map_contains_key(n["value"]["inputs"], "negative") & ~n["value"]["class_type"].startswith("KSampler"),
    )
    pick = F.coalesce(F.when(F.size(later) > 0, F.element_at(later, -1)), chosen)
    wildcard = F.get(F.reverse(F.filter(F.col("e"), lambda n: n["value"]["class_type"] == "ImpactWildcardProcessor")), F.lit(0))
    picked = base.withColumn("p", pick["value"]["inputs"]).withColumn("w", F.element_at(wildcard["value"]["inputs"], "populated_text"))

    def node(key: Column) -> Column:
        return F.element_at(F.col("g"), key)

    def encoder_text(key: Column) -> Column:
        text = F.coalesce(F.element_at(node(key)["inputs"], "text"), F.lit(""))
        ref = _reference(text)
        return F.when(ref.isNotNull(), F.coalesce(F.element_at(node(ref)["inputs"], "value"), F.lit(""))).otherwise(text)

    out = picked
    for side in ("positive", "negative"):
        def step(key: Column, _: Column) -> Column:
            is_text = node(key)["class_type"] == "CLIPTextEncode"
            return F.when(key.isNull() | F.coalesce(is_text, F.lit(False)), key).otherwise(
                _reference(F.element_at(node(key)["inputs"], "conditioning"))
            )

        out = out.withColumn(f"k_{side}", F.aggregate("e", _reference(F.element_at("p", side)), step))
        key = F.col(f"k_{side}")
        out = out.withColumn(
            side, F.when(node(key)["class_type"] == "CLIPTextEncode", encoder_text(key)).otherwise(F.lit(""))
        )
    positive = F.when(strip(F.col("w")) != "", F.col("w")).otherwise(F.col("positive"))
    return out.select(ident, F.coalesce(positive, F.lit("")).alias("positive"), F.coalesce("negative", F.lit("")).alias("negative"))


# Field labels of a parameter text block, in their order.
PARAM_LABELS = (
    "Negative prompt: ", "Steps: ", "Sampler: ", "CFG scale: ", "Seed: ", "Size: ", "Model hash: ",
    "Model: ", "Denoising strength: ", "Lora hashes: ", "Version: ",
)
LORA_TAG = r"<lora:([A-Za-z0-9\-]+):[0-9\.]+(?::[0-9\.]+)?>"


def parse_params_text(df: DataFrame, col: str) -> DataFrame:
    """Add positive, negative, model, seed, size, steps and loras parsed from a parameter text block.

    The positive text ends before the last 'Negative prompt: ' and at the first LoRA tag.
    """
    t = F.coalesce(F.col(col), F.lit(""))
    head = F.regexp_extract(t, r"(?s)^(.*)Negative prompt: ", 1)
    before_tag = strip(F.regexp_extract(head, rf"(?s)^(.*?){LORA_TAG}", 1))
    tail = F.regexp_extract(t, r"(?s)^.*(Negative prompt: .*)$", 1)

    def field(label: str, stop: str) -> Column:
        raw = strip(F.regexp_extract(tail, rf"(?s){label}(.*?){stop}", 1))
        return F.regexp_replace(F.regexp_replace(raw, r",$", ""), r'^"(.*)"$', "$1")

    return (
        df.withColumn("positive", F.when(head.rlike(LORA_TAG), before_tag).otherwise(head))
        .withColumn("negative", field("Negative prompt: ", "(?:Steps: |$)"))
        .withColumn("steps", field("Steps: ", "(?:Sampler: |$)"))
        .withColumn("seed", field("Seed: ", "(?:Size: |$)"))
        .withColumn("size", field("Size: ", "(?:Model hash: |$)"))
        .withColumn("model", field("Model: ", "(?:Denoising strength: |$)"))
        .withColumn("loras", F.regexp_extract_all(head, F.lit(LORA_TAG), F.lit(1)))
    )
