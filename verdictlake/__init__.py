"""verdictlake: evaluation analytics for multi-turn conversations on Spark.

Conversations, extracted claims, gathered evidence, judge responses and human
labels enter as tables or streams; scores, rates, agreement studies, resumable
work lists and evidence selections come out as DataFrames.
"""
