"""Where inputs and artifacts lie: plain path rules, without Spark."""

from __future__ import annotations

from pathlib import Path


def resolve_existing(raw: str, *roots: str | None) -> Path | None:
    """raw if it is absolute, else the first of root / raw that exists."""
    path = Path(raw)
    candidates = [path] if path.is_absolute() else [Path(r) / path for r in roots if r] + [Path.cwd() / path]
    return next((c for c in candidates if c.exists()), None)


def default_output(project: str) -> Path:
    return Path(project) / "output"


def resolve_services(raw: str, project: str, output: str | None = None) -> Path | None:
    """The services file: auto takes the project's own, then the one among the artifacts."""
    if raw != "auto":
        return resolve_existing(raw, output, project)
    return next((p for p in (Path(project) / "services.yaml", *([Path(output) / "services.yaml"] if output else [])) if p.exists()), None)


def scoped(args: dict, repo: str | None) -> dict:
    """Tool arguments with the session's repository in place of their own."""
    return args | {"repo_path": repo} if repo and "repo_path" in args else dict(args)
