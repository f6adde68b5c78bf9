"""Grounded generation: labelled context, prompts, a pluggable client, strict parsing of answers."""

from __future__ import annotations

import hashlib
import json
import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shipping import ship_package

PARSED = "answer string, cited array<long>, answerable boolean, error string"
_LABEL = re.compile(r"\[?\s*[Cc]\s*(\d+)\s*\]?")


def render_context(passages: DataFrame, by: str, order: str, title: str, text: str) -> DataFrame:
    """One context for each group: ``[C1] (title) text`` in order, blank lines between."""
    ranked = passages.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    line = F.concat(F.lit("[C"), F.col("_r").cast("string"), F.lit("] ("), F.coalesce(F.col(title), F.lit("")), F.lit(") "), F.coalesce(F.col(text), F.lit("")))
    grouped = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("_r"), line.alias("line")))).alias("lines"))
    return grouped.select(by, F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))


def placeholders(template: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(template) if name is not None}


def render_prompt(template: str, values: dict[str, Column]) -> Column:
    """A template's text with its placeholders filled; they must be exactly the given ones."""
    if placeholders(template) != set(values):
        raise ValueError(f"the template has {sorted(placeholders(template))}, given are {sorted(values)}")
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def prompt_digest(system: str, user: str) -> str:
    return hashlib.sha256(f"{system}\x00{user}".encode()).hexdigest()


#: What a decoded output must be, in the order of the checks: the test, and the error where it fails.
SHAPE = (
    (lambda d: isinstance(d, dict), "JSON is not an object"),
    (lambda d: isinstance(d.get("answer"), str) and not d["answer"].isspace() and d["answer"] != "", "'answer' missing, blank or not a string"),
    (lambda d: isinstance(d.get("citations"), list) and {type(c) for c in d["citations"]} <= {str}, "'citations' missing or not all strings"),
    (lambda d: isinstance(d.get("answerable"), bool), "'answerable' missing or not true or false"),
)


def chunk_label(cited: str) -> str:
    """A citation in the form in which passages are shown: ``[c 02]`` is C2."""
    found = _LABEL.fullmatch(cited.strip())
    return f"C{int(found[1])}" if found else cited.strip()


def parse_answer(output: str | None, shown: dict[str, int]) -> dict:
    """An answer from a model's output, or why it is refused; ``shown`` maps labels to chunk ids."""
    cited: dict[str, str] = {}
    try:
        data = json.loads(output or "")
        error = next((why for passes, why in SHAPE if not passes(data)), None)
        if error is None:
            cited = {chunk_label(c): c for c in data["citations"]}
            strange = [c for label, c in cited.items() if label not in shown]
            error = f"cited passages that are not shown: {strange}" if strange else "answerable=true but no citations" if data["answerable"] and not cited else None
    except json.JSONDecodeError as problem:
        error = f"not JSON: {problem.msg}"
    if error is not None:
        return {"answer": None, "cited": [], "answerable": None, "error": error}
    return {"answer": data["answer"].strip(), "cited": [shown[label] for label in cited], "answerable": data["answerable"], "error": None}


def parse_answers(outputs: DataFrame, id_col: str, output_col: str, chunks_col: str) -> DataFrame:
    """Parsed outputs of rows whose ``chunks_col`` has the shown chunk ids in order.

    JSON is read by Python's own reader on Arrow batches, since the JVM's readers convert
    values and accept trailing text.
    """
    ship_package(outputs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [parse_answer(o, {f"C{k}": c for k, c in enumerate(chunks or [], 1)}) for o, chunks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r["answer"] for r in rows], pa.string()), pa.array([r["cited"] for r in rows], pa.list_(pa.int64())), pa.array([r["answerable"] for r in rows], pa.bool_()), pa.array([r["error"] for r in rows], pa.string())],
                names=["id", "answer", "cited", "answerable", "error"],
            )

    return outputs.select(F.col(id_col).cast("long").alias("id"), output_col, F.col(chunks_col).cast("array<long>")).mapInArrow(run, f"id long, {PARSED}")


class ScriptedClient:
    """A client that answers from the prompt alone, for work without a network: cites the first passage."""

    provider, model, version = "scripted", "scripted-1", "scripted-1@" + "0" * 64

    def complete(self, system: str, user: str) -> dict:
        words = user.split()
        text = json.dumps({"answer": " ".join(words[-3:]) or "nothing", "citations": ["C1"] if "[C1]" in user else [], "answerable": "[C1]" in user}, ensure_ascii=False)
        return {"output": text, "tokens_in": len(system.split()) + len(words), "tokens_out": len(text.split())}


CALL = "id long, prompt_sha256 string, output string, provider string, model_requested string, model_reported string, model_version string, tokens_in long, tokens_out long"


def generate(prompts: DataFrame, make_client, system: str) -> DataFrame:
    """One call for each row of id and prompt, with its attribution; failures of parsing are stored too.

    ``make_client`` makes the client once in each task. A repeated task calls again,
    so rows should be written once by id.
    """
    ship_package(prompts.sparkSession)

    def run(batches):
        client = make_client()
        for batch in batches:
            rows = []
            for key, user in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = client.complete(system, user or "")
                rows.append({"id": key, "prompt_sha256": prompt_digest(system, user or ""), "provider": client.provider, "model_requested": client.model, "model_reported": client.model, "model_version": client.version} | got)
            kinds = {"id": pa.int64(), "tokens_in": pa.int64(), "tokens_out": pa.int64()}
            names = [f.split()[0] for f in CALL.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})

    return prompts.select(F.col("id").cast("long").alias("id"), "prompt").mapInArrow(run, CALL)
