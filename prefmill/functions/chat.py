"""Prompt templates and chat rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings forced on the generator and put back on its output.
VERIFIER_OPENING = "def evaluate(response: str) -> bool:"
TEST_CASE_OPENING = '{"response": "'
CODE_FENCE = "```"

# Our own wording. Each template is a parameter of the functions below.
INSTRUCTION_TEMPLATE = """Write instructions that extend a user's query with format rules.
A rule limits the form of the answer, never its tone, and a short Python function can check it.
Answer no query; only add rules to it. Examples:
{seeds}

Go on with new Query and Instruction lines in the same style."""

VERIFIER_TEMPLATE = """A user asks: {query}
The answer must follow this instruction: {instruction}

Write one Python function called evaluate. It takes the answer as a string and returns True
if the instruction is followed and False if not. Where the instruction has several fair
readings, accept each of them. Explain your steps in comments and write nothing after the function."""

TEST_CASE_TEMPLATE = """Write 2 test cases for the instruction "{instruction}".
Put each on a line of its own, as JSON with the keys response (a string) and result (true or false)."""

COMPLETION_TEMPLATE = """Your answer will be checked by this function, word for word:
```
{verifier}
```
Answer the query below so that the function accepts the whole answer. Write only the answer.

Query: {query}
Instruction: {instruction}"""


def fill(template: str, **slots: Column | str) -> Column:
    """Put columns into the named slots of a template in one concat."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{%s}" % name), name) for name in slots]
        found = [(at, name) for at, name in found if at >= 0]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        slot = slots[name]
        parts.append(slot if isinstance(slot, Column) else F.lit(slot))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


@dataclass(frozen=True)
class ChatStyle:
    """Marks around the messages of a rendered chat."""

    begin: str = "<|begin_of_text|>"
    role_open: str = "<|start_header_id|>"
    role_close: str = "<|end_header_id|>\n\n"
    turn_end: str = "<|eot_id|>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_chat(messages: Column, style: ChatStyle = ChatStyle(), reply: bool = False) -> Column:
    """Render an array of (role, content); ``reply`` adds an open assistant header."""
    turns = F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.lit(style.role_open), m["role"], F.lit(style.role_close),
                m["content"], F.lit(style.turn_end),
            ),
        ),
        "",
    )
    tail = f"{style.role_open}assistant{style.role_close}" if reply else ""
    return F.concat(F.lit(style.begin), turns, F.lit(tail))


def ask(content: Column, style: ChatStyle = ChatStyle()) -> Column:
    """One user message, ready for the reply."""
    return render_chat(F.array(message("user", content)), style, reply=True)


def instruction_prompt(
    query: Column, seeds: str, template: str = INSTRUCTION_TEMPLATE, style: ChatStyle = ChatStyle()
) -> Column:
    head = ask(fill(template, seeds=seeds), style)
    return F.concat(head, F.lit("\nQuery: "), query, F.lit("\nInstruction:"))


def verifier_prompt(
    query: Column, instruction: Column, template: str = VERIFIER_TEMPLATE,
    style: ChatStyle = ChatStyle(),
) -> Column:
    return F.concat(
        ask(fill(template, query=query, instruction=instruction), style),
        F.lit(CODE_FENCE + VERIFIER_OPENING),
    )


def test_case_prompt(
    query: Column, instruction: Column, verifier: Column,
    verifier_template: str = VERIFIER_TEMPLATE, template: str = TEST_CASE_TEMPLATE,
    style: ChatStyle = ChatStyle(),
) -> Column:
    """Three turns: the verifier question, the verifier as answer, the test case question."""
    chat = F.array(
        message("user", fill(verifier_template, query=query, instruction=instruction)),
        message("assistant", F.concat(F.lit(CODE_FENCE + "\n"), verifier, F.lit(CODE_FENCE))),
        message("user", fill(template, instruction=instruction)),
    )
    return F.concat(render_chat(chat, style, reply=True), F.lit(TEST_CASE_OPENING))


def completion_prompt(
    query: Column, instruction: Column, verifier: Column,
    template: str = COMPLETION_TEMPLATE, style: ChatStyle = ChatStyle(),
) -> Column:
    return ask(fill(template, query=query, instruction=instruction, verifier=verifier), style)


def training_prompt(query: Column, instruction: Column) -> Column:
    return F.concat(query, F.lit("\n"), instruction)
