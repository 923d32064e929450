from turnwise.plans.concordance import Concordance, TextLoader
from turnwise.plans.conversation import ConceptModel, Conversations, EmbeddingModel, VectorModel
from turnwise.plans.plot import ModelPlot, PlotTables

__all__ = [
    "ConceptModel",
    "Concordance",
    "Conversations",
    "EmbeddingModel",
    "ModelPlot",
    "PlotTables",
    "TextLoader",
    "VectorModel",
]
