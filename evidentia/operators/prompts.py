"""Prompt texts as expressions over evidence columns. Field labels are fixed values; system prompts are our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bullets, join_or_none

# Section labels of the prompt formats.
INPUT = "### Input:\n"
DISEASE = "Disease to be verified: "
PRESENT = "diagnostic_features_present: "
RELEVANT = "potentially_relevant_present_features: "
MISSING = "potentially_relevant_absent_features: "
PATHS = "Reasoning Paths:\n"

#: Fixed value: the closing sentence of each training instruction and of a custom one.
CLOSING = (
    "Reason and return the final answer derived from your reasoning, "
    "with **Yes** or **No** printed and specified in the end."
)

# Our own wording.
SYSTEM = {
    "default": "You get a disease, the features seen at the index visit, and those features that are known to bear on it, present and absent. Reason step by step whether the disease will be there at the next visit, and end with **Yes** or **No**.\n",
    "cradle": "You get a disease, the features seen at the index visit, and those features that are known to bear on it, present and absent. Reason step by step whether the disease will be there within one year, and end with **Yes** or **No**.\n",
    "no_kg": "You get a disease and the features seen at the index visit. Reason step by step, from general knowledge alone, whether the disease will be there at the next visit, and end with **Yes** or **No**.\n",
}


def generation_input(disease: Column, present: Column, relevant: Column, missing: Column, answer: Column, paths: Column | None = None) -> Column:
    """With the answer line; lists joined by semicolons; no paths block without ``paths``."""
    line = lambda label, a: F.concat(F.lit(label), join_or_none(a, "; "), F.lit("\n\n"))
    block = [] if paths is None else [F.lit(PATHS), bullets(paths), F.lit("\n\n")]
    return F.concat(F.lit(INPUT + DISEASE), disease, F.lit("\n\n"), line(PRESENT, present), line(RELEVANT, relevant), line(MISSING, missing), *block, F.lit("Answer: "), answer, F.lit("\n"))


def dataset_input(disease: Column, present: Column, relevant: Column, missing: Column, paths: Column | None = None) -> Column:
    """Without an answer; lists joined by commas; two spaces before the present features."""
    line = lambda label, a: F.concat(F.lit(label), join_or_none(a, ", "), F.lit("\n\n"))
    block = [] if paths is None else [F.lit(PATHS), bullets(paths), F.lit("\n\n")]
    return F.concat(F.lit(INPUT + DISEASE), disease, F.lit("\n\n"), line(PRESENT + " ", present), line(RELEVANT, relevant), line(MISSING, missing), *block)


#: Evaluation asks with the same text as the data set.
evaluation_input = dataset_input


def presence_input(disease: Column, present: Column, absent: Column | None = None) -> Column:
    """Features present, the disease and, if given, features absent."""
    tail = [] if absent is None else [F.lit("Patient features absent(truncated): "), join_or_none(absent, ", "), F.lit("\n")]
    return F.concat(F.lit(INPUT + "Patient features present: "), join_or_none(present, ", "), F.lit("\n" + DISEASE), disease, F.lit("\n"), *tail)


def instruction(disease: Column, variant: str = "default", custom: str | None = None) -> Column:
    """A built-in system prompt, or a custom text (``{disease}`` is filled in) and the closing sentence."""
    if custom is None:
        return F.lit(SYSTEM.get(variant.lower(), SYSTEM["default"]))
    parts = custom.strip().split("{disease}")
    body = [F.lit(parts[0])]
    for p in parts[1:]:
        body += [disease, F.lit(p)]
    return F.concat(*body, F.lit("\n" + CLOSING))


def answer(label: Column, style: str = "graph") -> Column:
    yes, no = ("**True**", "**False**") if style == "graph" else ("Yes", "No")
    return F.when(label == 1, yes).otherwise(no)


def messages(system: Column, user: Column) -> Column:
    """Chat messages as an array of (role, content)."""
    item = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(item("system", system), item("user", user))


def render_template(chat: Column, marks: dict[str, tuple[str, str]], opening: str) -> Column:
    """One prompt by a model's own marks: text before and after a message of each role, and what opens the answer.

    A role without marks goes as it is.
    """
    mark = lambda m, k: F.coalesce(*(F.when(m["role"] == r, F.lit(x[k])) for r, x in marks.items()), F.lit(""))
    return F.concat(F.array_join(F.transform(chat, lambda m: F.concat(mark(m, 0), m["content"], mark(m, 1))), ""), F.lit(opening))


def render(chat: Column, style: str = "plain") -> Column:
    """One prompt of the messages: ``plain`` has role lines; ``turns`` folds the system text into a user turn with turn marks."""
    if style == "turns":
        text = F.array_join(F.transform(chat, lambda m: m["content"]), "\n")
        return F.concat(F.lit("<start_of_turn>user\n"), text, F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    if style == "plain":
        return F.concat(F.array_join(F.transform(chat, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n"), F.lit("\nAssistant: "))
    raise ValueError(f"unknown style: {style}")
