"""Prompt side: chat rendering over conversation turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A small stand-in for a conversation template: system text, role names,
    separators.  The template registry of the original stack is external."""
    name: str = "plain"
    system: str = ""
    roles: tuple = (("user", "USER"), ("assistant", "ASSISTANT"), ("system", "SYSTEM"))
    role_sep: str = ": "
    turn_sep: str = "\n"


def render_chat_prompt(turns: DataFrame, template: ChatTemplate, conv: str = "conv_id", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """Turns in order, each ``ROLE<sep>text<turn_sep>``, then an open assistant turn."""
    role_map = F.create_map(*[x for pair in template.roles for x in (F.lit(pair[0]), F.lit(pair[1]))])
    shown = F.coalesce(role_map[F.col(role)], F.col(role))
    rendered = F.concat(shown, F.lit(template.role_sep), F.col(text), F.lit(template.turn_sep))
    assistant = dict(template.roles).get("assistant", "assistant")
    g = (turns.groupBy(conv)
         .agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), rendered.alias("r")))).alias("__t")))
    body = F.array_join(F.transform("__t", lambda x: x["r"]), "")
    return g.select(conv, F.concat(F.lit(template.system), body, F.lit(assistant + template.role_sep.rstrip())).alias("prompt"))
