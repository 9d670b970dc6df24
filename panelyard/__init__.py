"""Panelyard: entity-by-month panel analytics and strategy backtesting as Spark jobs."""
