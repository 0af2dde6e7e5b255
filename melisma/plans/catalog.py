"""All registered queries of the library proper, and their SQL."""

from ..functions import scalars  # noqa: F401  (registers its operators)
from ..operators import aggregates, anchored, articulation, bars, cores, decoders, drafts, edits, evidence, grid, harmony, joins, levels, pages, phrases, playback, quality, quantization, refine, rhythm, scores, sequences, words  # noqa: F401
from ..sources import documents, projects, score_documents, streams
from ..streaming import jobs
from .sqlop import REGISTRY


def queries() -> dict:
    return {name: op.query for name, op in REGISTRY.items()} | articulation.QUERIES | playback.QUERIES | quantization.QUERIES | words.QUERIES | pages.QUERIES | cores.QUERIES | decoders.QUERIES | phrases.QUERIES | rhythm.QUERIES | harmony.QUERIES | anchored.QUERIES | documents.QUERIES | projects.QUERIES | score_documents.QUERIES | projects.QUERIES | streams.QUERIES | jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: op.oracle() for name, op in REGISTRY.items()} | documents.ORACLES | projects.ORACLES | score_documents.ORACLES | streams.ORACLES | jobs.ORACLES
