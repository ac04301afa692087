"""Settings, from YAML text, the environment and arguments, each before the one it overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

PREFIX = "WEFTLINE_"


@dataclass(frozen=True)
class Settings:
    frontier_max_active: int = 512
    frontier_politeness: int = 5
    frontier_session_budget: int = 5
    fetcher_timeout_ms: int = 3000
    fetcher_user_agent: str = "Mozilla/5.0"
    fetcher_robots_agent: str = "gobot"
    ring_vnodes: int = 16
    ring_successors: int = 2
    batch_period_ms: int = 15_000
    warc_file_bytes: int = 1_000_000_000
    bloom_rate: float = 0.01

    def rounds(self):
        """What the crawl rounds take."""
        from .plans.rounds import Conf

        return Conf(max_active=self.frontier_max_active, politeness=self.frontier_politeness, session_budget=self.frontier_session_budget)

    def ring(self, members):
        from .operators import ring

        return ring.build(members, self.ring_vnodes)

    def neighbours(self, made):
        from .operators import ring

        return ring.neighbours(made, self.ring_successors)

    def fetcher(self, keep=lambda df: df, **how):
        """A fetch function for the rounds: robots files first, then pages, with the timeout and the agents set here."""
        from .sources import web

        return lambda rows: web.visit(rows, self.fetcher_robots_agent, keep, timeout_ms=self.fetcher_timeout_ms, agent=self.fetcher_user_agent, **how)

    def archive(self, records, folder: str):
        from .sources import warc

        return warc.write(records, folder, self.warc_file_bytes)

    def filters(self, seen):
        from .functions import sketch

        return sketch.build(seen, self.bloom_rate)

    def flush(self, stream, folder: str, checkpoint: str):
        from .streaming import crawl

        return crawl.flush_batches(stream, folder, checkpoint, f"{self.batch_period_ms} milliseconds")


#: Names that a settings file of the crawler uses for ours.
ALIASES = {"distributed.batch_period": "batch.period_ms", "distributed.vnode_num": "ring.vnodes", "distributed.succlist_length": "ring.successors", "fetcher.timeout": "fetcher.timeout_ms"}


def flat(lines: str) -> dict[str, str]:
    """Dotted keys of YAML text that nests mappings by indentation; comments, empty values and quotes around values go."""
    found, path = {}, []
    for line in lines.splitlines():
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        key, colon, value = bare.strip().partition(":")
        if not colon:
            continue
        depth = len(bare) - len(bare.lstrip())
        path = [(d, k) for d, k in path if d < depth]
        name = ".".join([*(k for _, k in path), key.strip()])
        if value.strip():
            found[name] = value.strip().strip("\"'")
        else:
            path.append((depth, key.strip()))
    return {ALIASES.get(k, k): v for k, v in found.items() if v}


def env_key(name: str) -> str:
    """An environment name as a setting: `__` stands for an underscore inside a word, `_` for the dot between words."""
    return name.lower().replace("__", " ").replace("_", ".").replace(" ", "_")


def settings(lines: str = "", env: dict[str, str] | None = None, args: dict[str, object] | None = None) -> Settings:
    """Values that aren't positive numbers or that don't parse keep the default."""
    found: dict[str, object] = dict(flat(lines))
    named = {env_key(k.removeprefix(PREFIX)): v for k, v in (env or {}).items() if k.startswith(PREFIX)}
    found |= {ALIASES.get(k, k): v for k, v in named.items()}
    found |= {k: v for k, v in (args or {}).items() if v is not None}
    out = Settings()
    for f in fields(Settings):
        raw = found.get(f.name.replace("_", ".", 1), found.get(f.name))
        kind = type(getattr(out, f.name))
        try:
            value = kind(raw) if raw is not None else None
        except (TypeError, ValueError):
            continue
        if value is not None and (kind is str or value > 0):
            out = replace(out, **{f.name: value})
    return out
