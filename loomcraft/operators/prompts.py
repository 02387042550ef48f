"""Prompt texts as Column expressions.

Templates are compiled on the driver into a concatenation of literals and columns; filling them in
is then ordinary generated code.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, functions as F

from ..functions.text import _col

# Section order of generation prompts and of system prompts.
SECTIONS = (
    "Role", "Objective", "Guidelines", "Documents", "Examples", "Output_instructions", "Output_schema", "Assistant",
)
SYSTEM_SECTIONS = ("Role", "Objective", "Tools", "Examples", "Schema", "Instructions")

# The prompt that extracts a task from a source file.
MINING_INTRO = (
    "Please extract tasks from given code file as a json object. "
    "The keys of the json object should be category, subcategory, task and schema."
    "The task should be about generating a json object representation to assist with a user query using agentic frameworks."
    "The code would usually have task description, pydantic model, json schema and json objects with key value pairs that will be input or output."
    "The task should not just be about creating a schema since schema would be provided but a json object adhering to the schema that assists with user query."
    "You may use the examples provided below as reference:\n"
)
MINING_CODE = "Please use the following code as reference for the task: "
MINING_SCHEMA = (
    "Return a single json object that adheres to the following pydantic json schema properties for your output:\n"
)
MINING_OUTRO = (
    "Do not return the pydantic schema as it is but json object with category, subcategory, task and schema keys"
)

# The prompt that turns an industry row into tasks.
INDUSTRY_TEMPLATE = """
        I have a json lines task list for various GICs industries to store json schema for data entry and api calls to enterprise databases or software applications.
        The current list is missing json schema part and I need you to help add the "Schema" key to the json lines row provided below.

        Here's an example of 5 json object tasks from healthcare industry to use as an example:
        {examples}

        Here are some instructions:
        - Please return 5 diverse tasks and examples in the same GICs industry.
        - The task should not just be about creating a schema but about creating a json object adhering to the schema that assists with user query.
        - The schema should be a json schema or a pydantic schema representing data sample entry to a database or API query to a software application.
        - Please enclose all the json objects as a list with [].
        - Please create tasks and schema for the same "Category" and "SubCategory" for all 5 rows.
        - Please use this schema as a guide for each entry of the json objects list:
        {schema}

        Here's the json lines row for GICs industry that you need to return a list of 5 json objects with the task updated and the schema added:
        {task}
        """

# The prompt that adds missing details to a user message.
ENRICH_MESSAGE = "Here's the user message that needs to be updated: "
ENRICH_OBJECT = (
    ".Please add missing details to the user message provided above that are needed to fill in the json object."
    "Here's the json object that has details that need to be provided as part of the user message: "
)
ENRICH_EXAMPLES = (
    ".Given the above json object, please generate a user message with missing details added from the json object."
    "Here are some example user messages:\n "
)
ENRICH_SCHEMA = '\nGenerate a json object with this schema \n{"updated_message": "<user-message>"}\n'
ENRICH_OUTRO = (
    "Do not rephrase the above user message but just add any missing details from the json object so json object can be filled."
    "You should begin the user message as it is but finish off with all the details from json object."
    "Do not rephrase the user message like this 'To assist you in generating the JSON object...'"
    "Use natural language to describe the information of the json object as much as you can in lengthy detail."
    "Please present the details in correct order avoiding any ambiguity."
    "You may include verbose text descriptions, paragraphs, excerpts, markdown tables, csv tables, etc in the user message that contain the details."
    "Your task is to simply return the user message as it is after adding detials missing from the json object"
)

# Fixed value: how failed calls are handed back for correction.
CORRECTION = "\n Here's the previously called functions with error message that need to be called correctly: "


def template(text: str, variables: Mapping[str, Column | str]) -> Column:
    """``{name}`` becomes the named column, ``{{`` and ``}}`` become braces."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(text):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(_col(variables[name]).cast("string"))
    return F.concat(*pieces) if pieces else F.lit("")


def section_prompt(sections: Mapping[str, str], variables: Mapping[str, Column | str]) -> Column:
    """The whole generation prompt: every section under its name, in fixed order."""
    parts = []
    for name in SECTIONS:
        parts += [F.lit(f"{name}:\n"), template(sections.get(name, ""), variables), F.lit("\n")]
    return F.concat(*parts)


def prompt_messages(
    sections: Mapping[str, str], variables: Mapping[str, Column | str], system_prefix: str = ""
) -> Column:
    """The prompt as a system and a user message. Only the user part has its variables filled in."""
    fixed = [sections.get(n, "") for n in ("Role", "Guidelines", "Output_instructions")]
    schema = variables.get("pydantic_schema")
    system = F.concat(
        F.lit(system_prefix + "\n".join(fixed) + "\n"), _col(schema) if schema is not None else F.lit("")
    )
    asked = [template(sections.get(n, ""), variables) for n in ("Objective", "Documents", "Examples", "Assistant")]
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat_ws("\n", *asked).alias("content")),
    )


def flat_system_prompt(sections: Mapping[str, str], variables: Mapping[str, Column | str]) -> Column:
    """A system prompt on one line, but for its instructions. The examples section goes when a row has none."""
    parts = []
    for name in SYSTEM_SECTIONS:
        if name == "Examples" and "examples" not in variables:
            continue
        text = template(sections.get(name, ""), variables)
        if name == "Instructions":
            parts.append(F.concat(text, F.lit("\n")))
        else:
            flat = F.replace(text, F.lit("\n"), F.lit(" "))
            parts.append(F.coalesce(flat, F.lit("")) if name == "Examples" else flat)
    return F.concat(*parts)


def mining_prompt(code, examples: Sequence[str], schema_text: str) -> Column:
    """Ask for a task that fits a source file."""
    shown = "".join(f"<example={i}> {e} </example>\n" for i, e in enumerate(examples))
    return F.concat(
        F.lit(MINING_INTRO + shown + MINING_CODE), _col(code), F.lit("\n" + MINING_SCHEMA + schema_text + "\n" + MINING_OUTRO)
    )


def industry_prompt(task_json, examples: str, schema_text: str) -> Column:
    """Ask for five tasks with schemas in the industry of a row."""
    return template(
        INDUSTRY_TEMPLATE, {"task": _col(task_json), "examples": F.lit(examples), "schema": F.lit(schema_text)}
    )


def enrichment_prompt(user_message, json_object, examples: Sequence[Mapping[str, str]] = ()) -> Column:
    """Ask for a user message that holds all details of the object it should lead to."""
    return F.concat(
        F.lit(ENRICH_MESSAGE), _col(user_message), F.lit(ENRICH_OBJECT), _col(json_object),
        F.lit(ENRICH_EXAMPLES + json.dumps(list(examples)) + ENRICH_SCHEMA + ENRICH_OUTRO),
    )


def correction_prompt(user_message, failed_results) -> Column:
    """Ask for failed calls to be made again; ``failed_results`` is JSON text."""
    return F.concat(_col(user_message), F.lit(CORRECTION), _col(failed_results))
