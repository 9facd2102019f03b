"""codegauge: source-code quality analytics as Spark jobs.

Tables of source lines, files, linter findings, commits and file-change events go in;
metrics, import graphs, risk, scores, snapshot diffs and incremental updates come out.
Everything is DataFrame / SQL; Python runs on executors only for the Python parser.
"""

from codegauge.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
