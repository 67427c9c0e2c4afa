"""Specs are Python modules with a function spec() that returns a Spec."""

from __future__ import annotations

import importlib.util
import os
import subprocess
from pathlib import Path

from ..spec import Model, Spec


def load(path: str) -> Model:
    """The model of a spec file; an error if the file has no spec() or it has faults."""
    at = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(at)
    at.loader.exec_module(module)
    if not hasattr(module, "spec"):
        raise ValueError(f"{path} has no function spec()")
    made = module.spec()
    if not isinstance(made, Spec):
        raise ValueError(f"spec() of {path} doesn't return a Spec")
    return made.build()


def changed_since(root: str, base: str, seconds: int = 30) -> list[str]:
    """Absolute paths of files in root's repository that git finds changed or gone since base, or
    untracked, each once, in order; root may be any folder of it."""
    def git(at: str, *args: str) -> str:
        run = subprocess.run(["git", "-C", at, *args], capture_output=True, timeout=seconds, check=False)
        if run.returncode:
            raise ValueError(f"git {args[0]} failed: {os.fsdecode(run.stderr).strip()}")
        return os.fsdecode(run.stdout)

    # what git names is relative to the top, wherever root is
    top = git(root, "rev-parse", "--show-toplevel").rstrip("\n")
    # a base that looks like an option is none
    commit = git(top, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{base}^{{commit}}").strip()
    named = git(top, "diff", "--name-only", "--no-renames", "-z", commit, "--") + git(top, "ls-files", "--others", "--exclude-standard", "--full-name", "-z")
    return sorted({os.path.join(top, x) for x in named.split("\0") if x})
