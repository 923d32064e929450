"""Text search and conversation analysis on Spark."""

from turnwise.plans import (
    ConceptModel,
    Concordance,
    Conversations,
    EmbeddingModel,
    ModelPlot,
    PlotTables,
    TextLoader,
    VectorModel,
)
from turnwise.session import configure, local_session, release, scratch

__all__ = [
    "ConceptModel",
    "Concordance",
    "Conversations",
    "EmbeddingModel",
    "ModelPlot",
    "PlotTables",
    "TextLoader",
    "VectorModel",
    "configure",
    "local_session",
    "release",
    "scratch",
]
