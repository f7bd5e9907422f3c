"""The driver's tables as payloads, vectors, references and scores, and the queries over them."""
