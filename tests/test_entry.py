"""The driver's entry: with and without the folder of training-data operators."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def run(folder):
    env = os.environ | {"PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    n, ops, pipeline = out.stdout.split()
    return int(n), int(ops), pipeline == "True"


def copy(tmp_path, *without):
    target = tmp_path / "repo"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *without))
    return target


def test_without_the_training_data_folder(tmp_path):
    n, ops, pipeline = run(copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert n > 100 and ops == 0 and not pipeline


def test_the_rest_is_whole_without_it(tmp_path):
    """With both folders and the pipeline gone, all other tests are still collected and those that need no tables pass."""
    folder = copy(tmp_path, "llm", "corpus_pipeline.py")
    env = os.environ | {"PYTHONPATH": str(folder)}
    run_ = lambda *args: subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    collected = run_("--collect-only", "tests")
    assert collected.returncode == 0, collected.stdout
    passed = run_("tests/test_parts.py")
    assert passed.returncode == 0, passed.stdout


def test_a_fault_within_is_not_hidden(tmp_path):
    folder = copy(tmp_path)
    with open(folder / "strandline" / "llm" / "queries.py", "a") as f:
        f.write("\nimport strandline.llm.no_such_module\n")
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert out.returncode != 0 and "no_such_module" in out.stderr


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "strandline")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f)).read()
                    assert not re.search(r"\bllm\b", text), f


def test_flagship(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
