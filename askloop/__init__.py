"""Multi-turn question-answering rollouts on Spark: prompt, answer, grade, gate, score."""
