"""The dialect's front end: text to tokens to a syntax tree. Nothing here touches Spark."""
