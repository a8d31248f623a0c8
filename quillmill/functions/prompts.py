"""Prompts of the stages that face a model, filled from columns.

Every template is a parameter; the ones here are the defaults. A placeholder is filled once:
braces inside a value stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import text_or_empty, ustrip
from quillmill.operators.reshape import chat

BOX = "\n\nWrite your final response in \\boxed{} on the last line."
_GRADING = "Task: QA answer grading\n\nContext:\n{content}\n\nQuestion:\n{question}\n\nReference answer:\n{reference}\n\nCandidate answer:\n{candidate}\n\n"

#: System and user text of each stage.
SYSTEM = {
    "margin_judge": "You are a strict QA evaluator. Respond with exactly one word: either 'yes' or 'no'. Do not emit any other text, punctuation, or explanation.",
    "judge": "You are a strict QA evaluator. After any thinking, respond with one JSON object only. Do not emit markdown or extra text outside the JSON.",
    "domains": "You generate diverse domain seed keywords.\nReturn keyword outputs only.\nDomains must be natural and intuitive for humans.\nEach domain seed must contain 2-4 words.",
    "generate": "You are a pragmatic QA data generator.\nGenerate exactly one item for the target section below.\n\nTarget section: {section}\nSection description: {description}\n\n"
    "Return plain text only with this exact format:\nQuestion must be impossible to answer without pragmatic interpretation. Answer must be short and clear.\nContent: ...\nQuestion: ...\nAnswer: ...\nNo JSON and no extra commentary.",
}
USER = {
    "margin_judge": _GRADING + "Is the candidate answer semantically correct given the context, question, and reference answer? Answer with a single word: yes or no.",
    "judge": _GRADING + "Is the candidate answer semantically correct given the context, question, and reference answer? Is the question itself answerable given the context? "
    'If the question is unanswerable, judge the candidate as incorrect.Return JSON only after thinking, with keys: "feedback" (short reason), and "corrected_answer" (empty if judgment is yes).'
    '"judgment" ("yes" or "no"), "confidence" (integer 1-10), ',
    "qa": "Task: QA.\nContext:\n{content}\n\nQuestion:\n{question}\n\nAnswer the question.\nOutput only the final answer text.\n" + BOX,
    "pragmatic_qa": "Task: Pragmatic QA.\nPragmatic Category: {section}\n{described}\nContext:\n{content}\n\nQuestion:\n{question}\n\n"
    "Answer the question by inferring the speaker's intended meaning in context.\nDo not rely on literal wording alone.\n"
    "Use the pragmatic category above as guidance for what kind of implied meaning to look for.\n"
    "Consider what the speaker is trying to communicate, why this wording was chosen, and what the listener is expected to infer from the context.\n"
    "Do not infer more than the context and category support.\nOutput only the final answer text.\n" + BOX,
    "refine": "Your previous answer was judged incorrect.\n\nPrevious final answer:\n{previous}\n\nJudge feedback:\n{feedback}\n\nReference-correct answer:\n{corrected}\n\n"
    "Answer the same question again. Output only the final answer text. " + BOX,
    "rationalize": "Your previous answer did not pass verification.\n\nPrevious final answer:\n{previous}\n\n{verifier}The correct final answer is:\n{reference}\n\n"
    "Generate a complete rationale that justifies this correct answer from the context. {instruction}Do not mention that the answer was provided as a hint. "
    "End with the exact correct final answer in \\boxed{} on the last line.",
    "domains": "Generate exactly {count} domain keywords.\nOutput plain text only as a numbered list, one domain seed per line.\nUse consecutive numbering from 1 to {count}.\n"
    "Format:\n1. domain seed\n2. domain seed\n...\n{count}. domain seed\nNo JSON and no commentary.\nKeep keywords concise (2-4 words) and maximize diversity.\n"
    "Stop after exactly {count} items.\nAvoid these existing keywords:\n{existing}",
    "generate": "Domain keyword: {domain}\nItem: {index}/{items}\n\nField definitions:\n- content: a concrete scenario/context only, with enough detail for pragmatic inference.\n"
    "- question: one explicit question about the scenario.\n- answer: a minimal, short, concise, single correct answer to the question without any explanation.\n{examples}"
    "Output plain text only with this exact format:\nContent: ...\nQuestion: ...\nAnswer: ...\nNo JSON, no markdown, no extra commentary.",
    "extract_number": "Extract the answer number from the text below. The answer is a single integer (1, 2, 3, or 4). Output ONLY the integer, nothing else.\n\nText:\n{text}\n\nAnswer number:",
}


def fill(template: str, **values: Column) -> Column:
    """A template with its placeholders filled; null fills nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def fill_sql(template: str, **values: str) -> str:
    """The same as SQL."""
    parts = re.split(r"\{(\w+)\}", template)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return " || ".join(f"coalesce({values[x]}, '')" if i % 2 else quote(x) for i, x in enumerate(parts) if i % 2 or x)


def judge_prompt(content: Column, question: Column, reference: Column, candidate: Column, margin: bool = True) -> Column:
    """Messages that ask whether an answer is right: for one word, or for a JSON object."""
    kind = "margin_judge" if margin else "judge"
    return chat(F.lit(SYSTEM[kind]), fill(USER[kind], content=content, question=question, reference=reference, candidate=candidate))


def qa_user(content: Column, question: Column, section: Column | None = None, description: Column | None = None) -> Column:
    """Question to a model; with a section as one of pragmatic meaning, with its description where it has one."""
    if section is None:
        return fill(USER["qa"], content=content, question=question)
    known = text_or_empty(description) if description is not None else F.lit("")
    described = F.when(known != "", F.concat(F.lit("Category Description: "), known, F.lit("\n"))).otherwise("")
    return fill(USER["pragmatic_qa"], section=section, described=described, content=content, question=question)


def _followed(messages: Column, *turns: tuple[str, Column]) -> Column:
    """The first two messages and further turns."""
    more = [F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in turns]
    return F.concat(F.slice(messages, 1, 2), F.array(*more))


def refine_prompt(messages: Column, previous: Column, feedback: Column, corrected: Column, reference: Column) -> Column:
    """Messages that ask again after a judgement; without a corrected answer the reference stands in."""
    said = F.coalesce(F.nullif(ustrip(feedback), F.lit("")), F.lit("Your previous output did not satisfy the task constraints."))
    right = F.coalesce(F.nullif(ustrip(corrected), F.lit("")), text_or_empty(reference))
    answer = text_or_empty(previous)
    return _followed(messages, ("assistant", F.coalesce(F.nullif(answer, F.lit("")), F.lit("(empty answer)"))), ("user", fill(USER["refine"], previous=answer, feedback=said, corrected=right)))


def rationalize_prompt(messages: Column, previous: Column, feedback: Column, reference: Column, instruction: str = "") -> Column:
    """Messages that give the right answer as a hint and ask for the reasons."""
    said = text_or_empty(feedback)
    verifier = F.when(said != "", F.concat(F.lit("Verifier feedback:\n"), said, F.lit("\n\n"))).otherwise("")
    shown = F.coalesce(F.nullif(ustrip(previous), F.lit("")), F.lit("(empty)"))
    return _followed(messages, ("user", fill(USER["rationalize"], previous=shown, verifier=verifier, reference=text_or_empty(reference), instruction=F.lit(instruction))))


def prefixed(prompt: Column, prefix: Column | None) -> Column:
    """A prompt with a text and a blank line before it, where there is one."""
    return prompt if prefix is None else F.when(text_or_empty(prefix) != "", F.concat(ustrip(prefix), F.lit("\n\n"), prompt)).otherwise(prompt)


def typed_system(raw: str, custom: str | None, begin: str = "[THINK]", end: str = "[/THINK]") -> list[dict]:
    """A system prompt as typed parts: the text before its thinking, the thinking, and the text after it with the custom text behind."""
    before, opened, rest = raw.partition(begin)
    thinking, closed, after = rest.partition(end)
    if not (opened and closed):
        raise ValueError("the system prompt has no thinking part")
    own = (custom or "").strip()
    suffix = "\n\n".join(x for x in (after.rstrip(), own) if x) if own else after
    return [{"type": "text", "text": before}, {"type": "thinking", "thinking": thinking, "closed": True}, {"type": "text", "text": suffix}]


def typed_content(parts: Column) -> Column:
    """Content of an array of (type, text, thinking) parts: what each says, with blank lines between."""
    said = F.transform(parts, lambda p: F.when(F.lower(ustrip(p["type"])) == "thinking", text_or_empty(p["thinking"])).otherwise(text_or_empty(p["text"])))
    return F.coalesce(F.array_join(F.filter(said, lambda x: x != ""), "\n\n"), F.lit(""))
