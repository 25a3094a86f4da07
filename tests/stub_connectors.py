"""Connectors to nowhere, which tests name on the command line."""

from quilate.operators import connect


def chat_registry():
    def maker(key):
        async def client(config, messages):
            if "falha" in messages[0]["content"]:
                raise TimeoutError("slow")
            return f"{config['model']}:{messages[0]['content']}"

        return client

    return connect.Registry({"openai": maker, "gemini": maker}, {"openai": ["k"], "gemini": ["k"]})


def sentiment_model():
    return lambda text: "LABEL_2:0.9" if "bom" in text else "LABEL_0:0.8"
