"""feedloom: document-feed and conversation-log analytics as Spark DataFrame operators."""
