"""Chat templates as text, and the markers that separate replies from prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Literal text around every turn, per role."""

    opening: str
    before: dict[str, str]
    after: dict[str, str]
    # Text that invites the next assistant turn.
    reply: str
    # Put a system turn in front of the first user turn's text.
    fold_system: bool = False


def _headers(before: str, after: str, **names: str):
    roles = {"system": "system", "user": "user", "assistant": "assistant", **names}
    return (
        {role: before.format(name) for role, name in roles.items()},
        dict.fromkeys(roles, after),
    )


# The published chat formats.
LLAMA_3 = ChatTemplate(
    "<|begin_of_text|>",
    *_headers("<|start_header_id|>{}<|end_header_id|>\n\n", "<|eot_id|>"),
    reply="<|start_header_id|>assistant<|end_header_id|>\n\n",
)
TEMPLATES = {
    "llama-3": LLAMA_3,
    "llama-3.1": LLAMA_3,
    "llama-3.2": LLAMA_3,
    "gemma-3": ChatTemplate(
        "<bos>",
        *_headers("<start_of_turn>{}\n", "<end_of_turn>\n", assistant="model"),
        reply="<start_of_turn>model\n",
        fold_system=True,
    ),
    "mistral": ChatTemplate(
        "<s>",
        {"system": "", "user": "[INST] ", "assistant": " "},
        {"system": "", "user": " [/INST]", "assistant": "</s>"},
        reply="",
        fold_system=True,
    ),
    "chatml": ChatTemplate(
        "",
        *_headers("<|im_start|>{}\n", "<|im_end|>\n"),
        reply="<|im_start|>assistant\n",
    ),
}

# Fixed values: (text to look for, whether the model name counts too,
# instruction marker, response marker); the first rule that applies wins.
MARKER_RULES = (
    ("chatml", False, "<|im_start|>user\n", "<|im_start|>assistant\n"),
    (
        "llama-3-8b",
        True,
        "<|start_header_id|>user<|end_header_id|>",
        "<|start_header_id|>assistant<|end_header_id|>",
    ),
    (
        "llama",
        True,
        "<|start_header_id|>user<|end_header_id|>\n\n",
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
    ),
    ("gemma", True, "<start_of_turn>user\n", "<start_of_turn>model\n"),
)

# Role names that count as user, assistant and system.
ROLE_NAMES = {
    "user": ("user", "human", "input"),
    "assistant": ("assistant", "gpt", "output"),
    "system": ("system",),
}

# The base models on offer with their templates.
MODEL_TEMPLATES = {
    "unsloth/Meta-Llama-3.1-8B-Instruct-unsloth-bnb-4bit": "llama-3.1",
    "unsloth/Llama-3.2-3B-Instruct-unsloth-bnb-4bit": "llama-3.2",
    "unsloth/llama-3-8b-Instruct-bnb-4bit": "llama-3",
}


def render(turns: Column, template: ChatTemplate, invite_reply: bool = False) -> Column:
    """One string for an array of turns with ``role`` and ``content``."""
    if template.fold_system:
        turns = _fold_system(turns)
    texts = F.transform(
        turns,
        lambda t: F.concat(
            _by_role(t["role"], template.before),
            t["content"],
            _by_role(t["role"], template.after),
        ),
    )
    closing = template.reply if invite_reply else ""
    return F.concat(F.lit(template.opening), F.array_join(texts, ""), F.lit(closing))


def _by_role(role: Column, texts: dict[str, str]) -> Column:
    chosen = F
    for name, text in texts.items():
        chosen = chosen.when(role == name, text)
    return chosen


def _fold_system(turns: Column) -> Column:
    def turn(t: Column, content: Column) -> Column:
        return F.struct(t["role"].alias("role"), content.alias("content"))

    body = F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))
    folded = F.transform(
        body,
        lambda t, i: turn(
            t,
            F.when(
                (i == 0) & (t["role"] == "user"),
                F.concat(turns[0]["content"], F.lit("\n\n"), t["content"]),
            ).otherwise(t["content"]),
        ),
    )
    plain = F.transform(turns, lambda t: turn(t, t["content"]))
    return F.when(turns[0]["role"] == "system", folded).otherwise(plain)


def response_markers(template: Column, model: Column) -> tuple[Column, Column]:
    """(instruction marker, response marker), NULL when no rule applies."""
    instruction = response = F
    for text, model_counts, ask, answer in MARKER_RULES:
        applies = template.contains(text)
        if model_counts:
            applies = applies | model.contains(text)
        instruction = instruction.when(applies, ask)
        response = response.when(applies, answer)
    return instruction, response


def response_spans(text: Column, instruction: Column, response: Column) -> Column:
    """Array of (text, is_target) that concatenates to the whole text.

    Targets lie between a response marker and the next instruction marker.
    Without markers everything is a target.
    """
    parts = F.split(text, F.concat(F.lit("\\Q"), response, F.lit("\\E")), F.lit(-1))

    def span(part: Column, is_target: bool) -> Column:
        return F.struct(part.alias("text"), F.lit(is_target).alias("is_target"))

    def pieces(part: Column, i: Column) -> Column:
        # The response marker that was split off belongs to the text before it.
        marker = F.when(i < F.size(parts) - 1, response).otherwise("")
        at = F.when(i == 0, 1).otherwise(F.position(instruction, part))
        return F.when(
            at > 0,
            F.array(
                span(F.substr(part, F.lit(1), at - 1), True),
                span(F.concat(F.substr(part, at), marker), False),
            ),
        ).otherwise(F.array(span(part, True), span(marker, False)))

    spans = F.filter(F.flatten(F.transform(parts, pieces)), lambda s: s["text"] != "")
    return F.when(response.isNotNull(), spans).otherwise(F.array(span(text, True)))


def standardize_roles(messages: Column) -> Column:
    """``{role, content}`` from messages that may use ``{from, value}`` instead."""

    def standard(m: Column) -> Column:
        given = F.coalesce(m["role"], m["from"])
        role = F
        for name, aliases in ROLE_NAMES.items():
            role = role.when(F.lower(given).isin(*aliases), name)
        return F.struct(
            role.otherwise(given).alias("role"),
            F.coalesce(m["content"], m["value"]).alias("content"),
        )

    return F.transform(messages, standard)
