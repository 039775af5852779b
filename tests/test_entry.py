"""The reports are registered whatever is missing for the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys, warnings
warnings.simplefilter("ignore")
sys.path.insert(0, {repo!r})
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {missing!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = entry.queries()
print(sum(not n.startswith("op") and n != "pipeline" for n in names), sum(n.startswith("op") for n in names), "pipeline" in names)
assert set(entry.oracle_sql()) <= set(names)
"""


def registered(repo, *missing):
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=str(repo), missing=missing)], capture_output=True, text=True, check=True, cwd=repo)
    reports, text, pipeline = out.stdout.split()[-3:]
    return int(reports), int(text), pipeline == "True"


def reports():
    import __spark_entry__ as entry

    return sum(not n.startswith("op") and n != "pipeline" for n in entry.queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "numpy"])
def test_without_a_library(missing):
    assert registered(REPO, missing)[0] == reports()


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_the_folders(tmp_path, gone):
    repo = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "tests", "__pycache__", *gone)
    shutil.copytree(REPO, repo, ignore=skip)
    count, text, pipeline = registered(repo)
    assert count == reports() and pipeline is False and (text == 0) == ("llm" in gone or not os.path.isdir(f"{REPO}/punctual/llm"))
    assert registered(repo, "public_tokenizers")[0] == count
