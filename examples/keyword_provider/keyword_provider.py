"""A provider plug-in: once this package is installed, models named ``keyword...`` are answered by it.

    REGISTRY.make("keyword-small", words=["rye", "salt"]).answer(prompt)
"""

import json
import re

from tessellate.operators.inference import Provider, ScoredOutput


class Keywords(Provider):
    """Every one of the given words that stands in the question is an extraction of the class ``word``."""

    PATTERNS = (r"^keyword\b",)
    raw_output = True
    remote = False

    def __init__(self, model: str, words: list[str], **settings):
        super().__init__(**settings)
        self.model = model
        self.pattern = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in words))

    def answer(self, prompt: str, **settings):
        question = prompt.rpartition("\nQ: ")[2].removesuffix("\nA: ")
        items = [{"word": m[0]} for m in self.pattern.finditer(question)] if self.pattern.pattern else []
        return [ScoredOutput(json.dumps({"extractions": items}), 1.0)]
